import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seqspark.operators import metrics, prefix


def test_running_sums(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.randrange(50), i, draw.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, i int, v int").repartition(7)
    for by in (["g"], []):
        got = prefix.running(df, by, [F.desc("x"), F.col("i")], {"upto": "v"}, {"whole": "v"})
        want, sums = {}, {}
        for g, x, i, v in sorted(rows, key=lambda r: (-r[1], r[2])):
            k = g if by else 0
            sums[k] = sums.get(k, 0) + v
            want[i] = sums[k]
        found = got.collect()
        assert len(found) == len(rows) and all(r["upto"] == want[r["i"]] and r["whole"] == sums[r["g"] if by else 0] for r in found)
    assert prefix.running(df.where("false"), ["g"], [F.col("x")], {"upto": "v"}).collect() == []


def test_running_by_value(spark):
    draw = random.Random(4)
    seen = {(draw.choice(["a", "a", "b", None]), draw.choice([None, float("inf"), -1.0, draw.gauss(0, 1), float(draw.randrange(9))])): draw.randrange(9) for _ in range(900)}
    df = spark.createDataFrame([(g, x, v) for (g, x), v in seen.items()], "g string, x double, v int").repartition(5)
    for descending in (False, True):
        got = prefix.running_by_value(df, ["g"], "x", {"upto": "v"}, {"whole": "v"}, descending).collect()
        want, sums = {}, {}
        for (g, x), v in sorted(seen.items(), key=lambda r: (r[0][1] is not None, r[0][1] or 0.0), reverse=descending):
            sums[g] = sums.get(g, 0) + v
            want[g, x] = sums[g]
        assert len(got) == len(seen) and all(r["upto"] == want[r["g"], r["x"]] and r["whole"] == sums[r["g"]] for r in got)
    assert prefix.running_by_value(df.where("false"), ["g"], "x", {"upto": "v"}).collect() == []


def test_one_large_group_is_no_single_task(spark):
    rows = spark.range(20_000).select((F.col("id") % 3 == 0).cast("int").alias("label"), (F.hash("id") % 1000 / 1000).alias("score"))
    pairs = [(r["label"], r["score"]) for r in rows.collect()]
    negatives = sorted(s for y, s in pairs if y == 0)
    assert metrics.order_threshold(rows, []).first()["threshold"] == negatives[math.ceil(len(negatives) * 0.95) - 1] + 1e-9
    assert abs(metrics.quantile_threshold(rows, []).first()["threshold"] - float(np.quantile(negatives, 0.95))) < 1e-12
    steps = metrics.score_steps(rows, [])
    assert sorted((r["score"], r["tp"]) for r in steps.collect()) == sorted((s, sum(y for y, t in pairs if t >= s)) for s in {s for _, s in pairs})
    whole = [x for x in steps._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in x and "score" in x.split("windowspec")[-1]]
    assert whole and all("_range" in x for x in whole)


def test_rank_correlation_with_ties(spark):
    draw = random.Random(6)
    rows = [(f, r, draw.randrange(2), float(draw.choice([draw.randrange(4), 1.5]))) for f in "ab" for r in ("1", "2") for _ in range(60)] + [("c", "1", i % 2, 7.0) for i in range(20)]
    df = spark.createDataFrame(rows, "feature string, release string, label int, value double")
    got = {(r["feature"], r["release"]): r["rho"] for r in metrics.rank_correlations(df).collect()}
    table = pd.DataFrame(rows, columns=["feature", "release", "label", "value"])
    want = {k: g["value"].rank().corr(g["label"].rank()) for k, g in table.groupby(["feature", "release"]) if g["value"].nunique() > 1}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
