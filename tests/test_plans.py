import pytest
from pyspark.sql import functions as F

from seqspark.operators import metrics
from seqspark.plans import learners
from seqspark.sources import io

X = ["x0", "x1", "hf_x2", "hf_x3"]


@pytest.fixture(scope="module")
def rows(spark):
    label = (F.pmod(F.xxhash64("id"), F.lit(2)) == 1).cast("int")
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000
    df = spark.range(240).select(F.col("id").alias("group_id"), (F.col("id") % 6).cast("string").alias("release"), label.alias("label"), "id")
    for i, c in enumerate(X):
        df = df.withColumn(c, F.col("label") * (0.8 if i % 2 == 0 else -0.4) + noise(i))
    return df.drop("id").persist()


def auc(df):
    return metrics.ranking_metrics(df, []).first()["auc"]


@pytest.mark.parametrize("name", sorted(learners.REGISTRY))
def test_every_learner_separates(rows, name):
    assert auc(learners.learner(name, X)(rows)(rows)) > 0.8


def test_out_of_fold_covers_each_row_once(rows):
    out = learners.out_of_fold(learners.learner("logistic", X), rows)
    assert out.count() == 240 and auc(out) > 0.8


def test_ensembles(rows):
    members = {"a": (learners.learner("logistic", X, to="a"), 2.0), "b": (learners.learner("forest", X, to="b"), 1.0)}
    assert auc(learners.soft_vote(members)(rows)(rows)) > 0.8
    assert auc(learners.stacked({n: f for n, (f, _) in members.items()})(rows)(rows)) > 0.8
    assert auc(learners.calibrated(learners.learner("logistic", X))(rows)(rows)) > 0.8
    assert auc(learners.subspace_ensemble(X, n=2)(rows)(rows)) > 0.8
    assert auc(learners.pairwise_ranker(X)(rows)(rows)) > 0.8


def test_committee_keeps_signs(rows):
    signs = {"x0": 1, "x1": 1, "hf_x2": 1, "hf_x3": 0}
    out = learners.signed_committee(X, signs)(rows)(rows)
    assert auc(out) > 0.8


def test_walk_forward_and_comparison(rows):
    report = learners.walk_forward(learners.learner("logistic", X), rows, latest=2)
    assert report.report.count() == 2 and set(report.thresholds) == {"4", "5"}
    table = learners.compare({"logistic": learners.learner("logistic", X), "pca": learners.learner("logistic_pca", X)}, rows, latest=1)
    assert {r["candidate"] for r in table.collect()} == {"logistic", "pca"}


def test_search_and_model_files(rows, tmp_path, spark):
    found = learners.random_search("logistic", {"regParam": [0.001, 0.1]}, 2, rows, X)
    assert found.count() == 2 and found.first()["auc"] > 0.8
    model = learners.fit("logistic", rows, X)
    io.write_model(model, str(tmp_path / "m"), "single", X, 0.4, {"score": 1.0})
    again, serving = io.read_model(spark, str(tmp_path / "m"))
    assert serving["threshold"] == 0.4 and auc(learners.scored(again, rows)) == pytest.approx(auc(learners.scored(model, rows)))


def test_four_parts_and_deployment(rows):
    parts = learners.four_parts(X, {"x0": 1, "x1": -1})
    out = rows
    for f in (parts["mono"], parts["mlp"]):
        out = f(rows)(out)
    assert {"mono", "mlp"} <= set(out.columns)
    score, threshold = learners.deployed(learners.learner("logistic", X), rows)
    assert 0 < threshold < 1 and score(rows).count() == 240


@pytest.mark.parametrize("name", ["platt_scores", "stacked_scores", "signed_scores", "subspace_scores", "deployed_scores", "hybrid_scores", "four_part_scores"])
def test_learner_queries_score_every_row(name, spark):
    from seqspark.queries import QUERIES
    from tests.compare import DATA

    rows = QUERIES[name](spark, DATA).collect()
    groups = 500 if name != "hybrid_scores" else len({r["group_id"] for r in rows})
    assert len(rows) == groups > 1 and all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows}) > 1


def test_a_written_model_is_served_by_its_kind(spark, tmp_path):
    from seqspark.sources import io

    rows = spark.createDataFrame([(i, str(i % 3), i % 2, float(i % 2) + i / 100) for i in range(60)], "group_id long, release string, label int, a double")
    model = learners.fit("logistic", rows, ["a"])
    io.write_model(model, str(tmp_path / "m"), "single", ["a"], 0.5, {"score": 1.0})
    again, serving = io.read_model(spark, str(tmp_path / "m"))
    direct = {r["group_id"]: r["score"] for r in learners.scored(model, rows).collect()}
    served = {r["group_id"]: r["score"] for r in learners.served_from(rows, again, serving).collect()}
    assert all(abs(direct[k] - served[k]) < 1e-9 for k in direct)
    parts = rows.select("group_id", F.lit(0.2).alias("tabular"), F.lit(0.6).alias("pooled"))
    out = learners.served_from(parts, None, {"kind": "hybrid", "weights": {"tabular": 0.6, "pooled": 0.4}, "threshold": 0.5})
    assert abs(out.first()["score"] - 0.36) < 1e-9
    with pytest.raises(ValueError):
        learners.blend_kind("unknown", {"a": 1.0})


def test_fits_run_side_by_side(rows):
    import threading

    both = threading.Barrier(2, timeout=60)  # breaks where one fit waits for the other to end

    def member(to):
        def fit_one(train):
            both.wait()
            return lambda df: df.withColumn(to, F.lit(0.5))

        return fit_one

    assert {"a", "b"} <= set(learners.together([member("a"), member("b")])(rows)(rows).columns)
    assert learners.out_of_fold(member("a"), rows, 2).count() == 240


def test_random_cut_trees_add_one_expression_a_tree(spark):
    facts = [(i, i % 2, float(i % 7) if i % 5 else None, float("nan") if i % 11 == 0 else i / 60) for i in range(60)]
    df = spark.createDataFrame(facts, "group_id long, label int, a double, b double")
    out = learners.random_cut_trees(["a", "b"], trees=2, cuts=5)(df)(df)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("coalesce(") == 0 and out.where("score BETWEEN 0 AND 1").count() == 60
