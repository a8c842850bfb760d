import math
import random

import pytest
from pyspark.sql import functions as F

from seqspark.operators import metrics, selection
from seqspark.plans import boosting, learners
from seqspark.plans.boosting import Node


def average_precision(labels):
    hits, out = 0, 0.0
    for i, y in enumerate(labels):
        hits += y
        out += y * hits / (i + 1)
    return out / sum(labels)


def plain_gradients(rows):
    """rows: (release, score, label), scores distinct -> {(release, score): (g, h)}, pair by pair, by changing places and counting anew."""
    out = {}
    for release in {r for r, _, _ in rows}:
        ranked = sorted(((s, y) for r, s, y in rows if r == release), reverse=True)
        labels = [y for _, y in ranked]
        base = average_precision(labels)
        g, h = [0.0] * len(labels), [0.0] * len(labels)
        for i, (si, yi) in enumerate(ranked):
            for j, (sj, yj) in enumerate(ranked):
                if yi == 1 and yj == 0:
                    other = labels[:]
                    other[i], other[j] = 0, 1
                    change, p = abs(average_precision(other) - base), 1 / (1 + math.exp(si - sj))
                    g[i] += change * p
                    g[j] -= change * p
                    h[i] += change * p * (1 - p)
                    h[j] += change * p * (1 - p)
        out |= {(release, s): (g[i], h[i]) for i, (s, _) in enumerate(ranked)}
    return out


def test_gradients_are_those_of_all_pairs(spark):
    draw = random.Random(4)
    rows = [(r, float(s), draw.choice((0, 0, 1))) for r, n in (("a", 40), ("b", 25), ("c", 2)) for s in draw.sample(range(-30, 30), n)]
    rows = [(r, s / 10, y) for r, s, y in rows] + [("only", 0.5, 1), ("only", 0.7, 1)]
    some = [x for x in rows if {y for r, _, y in rows if r == x[0]} == {0, 1}]
    df = spark.createDataFrame(rows, "release string, margin double, label int")
    got = {(r["release"], round(r["score"], 6)): (r["g"], r["h"]) for r in boosting.rank_gradients(df, 4096).collect()}
    want = {(r, round(s, 6)): x for (r, s), x in plain_gradients(some).items()}
    assert set(got) == set(want) and len(got) >= 65
    for k, (g, h) in want.items():
        assert got[k][0] == pytest.approx(g, abs=1e-12) and got[k][1] == pytest.approx(h, abs=1e-12)


def test_gradients_of_ties_pull_labels_apart_and_cancel(spark):
    rows = [("a", 0.0, i % 4 == 0) for i in range(400)] + [(None, 0.0, True), ("a", 0.0, None), ("a", None, True)]
    df = spark.createDataFrame([(r, m, None if y is None else int(y)) for r, m, y in rows], "release string, margin double, label int")
    got = {r["label"]: r for r in boosting.rank_gradients(df).collect()}
    assert got[1]["g"] > 0 > got[0]["g"] and 100 * got[1]["g"] + 300 * got[0]["g"] == pytest.approx(0, abs=1e-9)
    assert got[1]["h"] == pytest.approx(got[1]["g"] / 2)
    assert boosting.rank_gradients(df.limit(0)).count() == 0


def made(spark, n=600):
    x = [F.round(F.sin(F.col("id") * (k + 1.37)), 6).alias(f"x{k}") for k in range(4)]
    rows = spark.range(n).select(F.col("id").alias("group_id"), (F.col("id") % 6).cast("string").alias("release"), *x)
    return rows.withColumn("label", ((F.col("x0") * F.col("x1") + F.col("x2") / 2) > 0.35).cast("int"))


def within(rows):
    return metrics.ranking_metrics(rows, ["release"]).agg(F.avg("ap")).first()[0]


def test_ranker_beats_the_linear_one_on_releases_it_has_not_seen(spark):
    rows, columns = made(spark).persist(), [f"x{k}" for k in range(4)]
    train, held = selection.before_release(rows, "4"), rows.where("release >= '4'")
    boosted = within(boosting.lambda_ranker(columns)(train)(held))
    linear = within(learners.pairwise_ranker(columns)(train)(held))
    assert boosted >= linear and boosted > 0.85
    with pytest.raises(ValueError):
        boosting.lambda_ranker(columns)(train.where("label = 1"))


def test_ranker_is_the_same_however_rows_are_dealt(spark):
    rows, columns = made(spark, 200), [f"x{k}" for k in range(4)]
    found = []
    for n in (2, 16):
        dealt = rows.repartition(n)
        found.append({r["group_id"]: round(r["score"], 6) for r in boosting.lambda_ranker(columns, rounds=3)(dealt)(dealt).collect()})
    assert found[0] == found[1] and len(found[0]) == 200


def test_signs_are_kept_by_any_tree():
    draw = random.Random(3)

    def grown(depth):
        if depth == 0:
            return Node(draw.uniform(-1, 1))
        left, right = grown(depth - 1), grown(depth - 1)
        return Node((left.value + right.value) / 2, draw.randrange(3), draw.uniform(0, 1), left, right)

    def value(tree, x):
        while tree.left is not None:
            tree = tree.left if x[tree.feature] <= tree.threshold else tree.right
        return tree.value

    changed = 0
    for _ in range(300):
        tree, signs = grown(4), [1, -1, 0]
        kept = boosting.signed(tree, signs)
        changed += kept != tree
        for _ in range(30):
            x = [draw.uniform(0, 1) for _ in range(3)]
            y = [min(1, x[0] + draw.uniform(0, 0.5)), max(0, x[1] - draw.uniform(0, 0.5)), x[2]]
            assert value(kept, y) >= value(kept, x)
    assert changed > 200
    fits = Node(0.0, 0, 0.5, Node(-1.0), Node(1.0))
    assert boosting.signed(fits, [1]) == fits and boosting.leaves(boosting.signed(fits, [-1])) == [0.0, 0.0]


def test_raising_a_signed_feature_never_lowers_the_score(spark):
    rows, signs = made(spark).persist(), {"x0": 1, "x1": -1, "x2": 1, "x3": 0}
    columns = list(signs)
    score = boosting.monotone_trees(columns, signs, seeds=(1, 2), rounds=5)(rows)
    before = score(rows).select("group_id", F.col("score").alias("before")).persist()
    for c, by in (("x0", 0.4), ("x1", -0.4), ("x2", 0.05), ("x3", 3.0)):
        assert before.join(score(rows.withColumn(c, F.col(c) + by)), "group_id").where("score < before").isEmpty()
    assert metrics.ranking_metrics(score(rows), []).first()["auc"] > 0.75
    assert {r["score"] for r in boosting.monotone_trees(columns, {})(rows)(rows).collect()} == {0.5}
    odd = rows.withColumn("x0", F.when(F.col("group_id") % 5 != 0, F.col("x0"))).withColumn("features_of_mine", F.lit(1))
    out = boosting.monotone_trees(columns, signs, seeds=(1,), rounds=2)(odd)(odd)
    assert out.count() == 600 and out.where("score IS NULL").isEmpty() and "features_of_mine" in out.columns
