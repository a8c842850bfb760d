import pytest
from pyspark.sql import functions as F

from seqspark.operators import sets
from seqspark.plans import features, learners
from seqspark.sources import views
from tests.compare import DATA


def test_only_what_is_asked_is_aggregated(spark):
    own = features.Feature("mean_size", "action", ("norm_bb",), lambda: F.avg("norm_bb"))
    seq = views.short(spark, DATA)
    registry = features.Registry().having(own)
    out = registry.plan(seq, ["hf_hand_count", "mean_size"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns == ["group_id", "hf_hand_count", "mean_size"] and "percentile" not in plan and "hf_stack" not in plan
    want = {r["group_id"]: r["m"] for r in seq.actions.groupBy("group_id").agg(F.avg("norm_bb").alias("m")).collect()}
    assert {r["group_id"]: r["mean_size"] for r in out.collect()} == want
    assert features.Registry().features == {}
    with pytest.raises(ValueError):
        registry.plan(seq, ["no_such_feature"])
    with pytest.raises(ValueError):
        registry.having(own)
    with pytest.raises(ValueError):
        features.Feature("x", "no_such_grain", (), lambda: F.count("*"))


def test_settings_come_from_the_session(spark):
    spark.conf.set("seqspark.pool_cap", "7")
    try:
        assert features.Settings.of(spark) == features.Settings(pool_cap=7)
    finally:
        spark.conf.unset("seqspark.pool_cap")


def _rows(spark, n=240):
    x = [F.round(F.sin(F.col("id") * (k + 1)), 6).alias(f"x{k}") for k in range(4)]
    return spark.range(n).select(F.col("id").alias("group_id"), (F.col("id") % 4).cast("string").alias("release"), *x).withColumn("label", (F.col("x0") + F.col("x1") > 0).cast("int"))


def test_partitions_change_no_draw_and_no_score(spark):
    rows, columns = _rows(spark), [f"x{k}" for k in range(4)]
    found = []
    for n in (2, 32):
        dealt = rows.repartition(n)
        weights = {r["group_id"]: r["weight"] for r in sets.bootstrap(dealt, 3).collect()}
        scored = learners.subspace_ensemble(columns, n=2, share=0.75)(dealt)(dealt)
        found.append((weights, {r["group_id"]: round(r["score"], 9) for r in scored.collect()}))
    assert found[0] == found[1] and len(found[0][1]) == 240
    assert abs(sum(found[0][0].values()) - 240) < 60


def test_random_cuts(spark):
    rows = _rows(spark)
    cuts = learners.random_cuts(rows, ["x0", "x1"], 5, 1)
    assert cuts == learners.random_cuts(rows.repartition(7), ["x0", "x1"], 5, 1) != learners.random_cuts(rows, ["x0", "x1"], 5, 2)
    assert all(-1 <= p <= 1 for edges in cuts.values() for p in edges) and len(cuts["x0"]) == 5
    out = learners.random_cut_trees([f"x{k}" for k in range(4)], trees=4)(rows)(rows)
    right = out.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.85
