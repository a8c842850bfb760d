import json

import pytest
from pyspark.sql import functions as F

from seqspark.plans import search


def test_rungs_and_draws():
    assert search.rungs(50) == [(50, 1 / 9), (17, 1 / 3), (6, 1)]
    assert search.rungs(1) == [(1, 1)] and search.rungs(4, 2, 5) == [(4, 0.25), (2, 0.5), (1, 1)]
    space = {"regParam": (1e-4, 1.0), "maxIter": [5, 10]}
    assert search.drawn_settings(space, 20, 3) == search.drawn_settings(space, 20, 3) != search.drawn_settings(space, 20, 4)
    assert all(1e-4 <= s["regParam"] <= 1 and s["maxIter"] in (5, 10) for s in search.drawn_settings(space, 20, 3))
    with pytest.raises(ValueError):
        search.drawn_settings({"maxIter": [5, 10]}, 3, 1)


def test_halving_promotes_the_best_of_each_rung(spark):
    noise = lambda k: F.pmod(F.xxhash64("group_id", F.lit(k)), F.lit(1000)) / 1000
    rows = spark.range(360).select(F.col("id").alias("group_id"), (F.col("id") % 6).cast("string").alias("release"))
    rows = rows.withColumn("label", (noise(9) > 0.5).cast("int")).withColumn("a", F.col("label") + noise(1)).withColumn("b", noise(2))
    found = search.halved_search("logistic", {"regParam": (1e-4, 10.0), "elasticNetParam": [0.0, 1.0]}, 6, rows, ["a", "b"], eta=2, seed=1).collect()
    by = [[r for r in found if r["rung"] == k] for k in range(3)]
    assert [len(x) for x in by] == [6, 3, 2] and by[2][0]["n_rows"] == 360 and by[0][0]["n_rows"] < by[1][0]["n_rows"] < 360
    for now, after in zip(by, by[1:], strict=False):
        best = sorted(now, key=lambda r: (-r["auc"], r["trial"]))[: len(after)]
        assert {r["trial"] for r in after} == {r["trial"] for r in best} == {r["trial"] for r in now if r["promoted"]}
    assert not any(r["promoted"] for r in by[2]) and by[2][0]["auc"] > 0.8 and "regParam" in json.loads(by[2][0]["params"])
