import time

import pytest
from pyspark.sql import functions as F

from seqspark.operators import scores
from seqspark.queries import QUERIES
from seqspark.streaming import jobs, pool, requests


def _append(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


REQUEST = "batch_id int, idx int, n_rows int, raw double"


def test_a_split_request_is_ranked_as_one(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = [(b, i, 20 if b < 2 else 3, (i * 7 % 20) / 20 if i % 6 else None) for b in range(3) for i in range(20 if b < 2 else 3)]
    for part in range(3):
        _append(spark, [r for i, r in enumerate(rows) if i % 3 == part] + [rows[0]], REQUEST, source)
    score = lambda df: df.withColumn("score", F.col("raw"))
    requests.score_requests(_stream(spark, REQUEST, source), score, sink, mark).awaitTermination()
    whole = spark.createDataFrame(rows, REQUEST).withColumn("score", scores.neutral_on_failure(F.col("raw")))
    want = {(r["batch_id"], r["idx"]): r["score"] for r in scores.batch_rank(whole).collect()}
    got = spark.read.parquet(sink).collect()
    assert len(got) == len(want) and all(r["is_whole"] for r in got)
    assert {(r["batch_id"], r["idx"]): round(r["score"], 12) for r in got} == {k: round(v, 12) for k, v in want.items()}


def test_what_stays_incomplete_goes_out_when_its_time_is_up(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    run = lambda: requests.score_requests(_stream(spark, REQUEST, source), lambda df: df.withColumn("score", F.col("raw")), sink, mark, wait_ms=500).awaitTermination()
    _append(spark, [(0, i, 9, 0.1 * i) for i in range(5)] + [(1, 0, None, 0.9)], REQUEST, source)
    run()
    assert [r["batch_id"] for r in spark.read.parquet(sink).collect()] == [1]
    time.sleep(1)
    _append(spark, [(2, 0, 1, 0.4)], REQUEST, source)
    run()  # a restart: the state is that of the checkpoint
    got = {(r["batch_id"], r["idx"]): r["is_whole"] for r in spark.read.parquet(sink).collect()}
    assert got == {**{(0, i): False for i in range(5)}, (1, 0): True, (2, 0): True}


ROW = "key string, at int, x double, y double"


def test_the_pool_keeps_its_bound_over_restarts(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    bench = spark.range(50).select((F.col("id") / 7).alias("x"), F.sin("id").alias("y"))
    parts = [[("a", 1, 1.0, 2.0), ("a", 0, 5.0, 6.0), ("b", 2, 2.0, None), (None, 3, 0.0, 0.0)], [("b", 4, 9.0, 9.0), ("c", 6, 3.0, 1.5), ("d", 5, 4.0, 0.5)], [("e", 7, 1.0, 1.0), ("f", 9, 1.0, 1.0), ("a", 8, 7.0, 7.0)], [("g", 10, 1.0, 1.0), ("a", 11, 1.0, 1.0)]]
    sizes = []
    for part in parts:
        _append(spark, part, ROW, source)
        pool.capture(_stream(spark, ROW, source), "key", "at", sink, mark, cap=5, live_ms=1, features=["x", "y"]).awaitTermination()
        held = pool.pool(spark, sink, spark.createDataFrame([], ROW).schema)
        sizes.append(held.count())
        drift = pool.shift_by_moments(pool.newest_moments(spark, sink), pool.moments(bench, ["x", "y"]))
        a = {r["feature"]: r["z"] for r in drift.collect()}
        b = {r["feature"]: r["z"] for r in jobs.drift_report(held.select("x", "y"), bench, ["x", "y"]).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-9 * max(1, abs(b[k])) for k in a)
    # the keys are forgotten at once (live_ms), yet a and b do not come in again
    assert sizes == [2, 4, 5, 5] and sorted((r["key"], r["at"]) for r in held.collect()) == [("a", 0), ("b", 2), ("c", 6), ("d", 5), ("e", 7)]


def test_drift_counts_every_captured_vector(spark, tmp_path):
    """More than 3,000 live vectors (F2): the later ones shift the first feature."""
    row = F.array(F.when(F.col("vec_id") > 26_000, 5.0).otherwise(F.sin("vec_id")), *[F.cos(F.col("vec_id") * k) for k in range(2, 65)]).cast("array<float>")
    vectors = spark.range(32_000).withColumnRenamed("id", "vec_id")
    vectors.select("vec_id", row.alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    table = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(64)])
    want = jobs.drift_report(table.where("vec_id % 8 = 7"), table.where("vec_id % 8 <> 7"), [f"f{k}" for k in range(64)])
    got = QUERIES["captured_drift"](spark, str(tmp_path)).collect()
    assert [(r["feature"], r["z"]) for r in got] == [(r["feature"], round(r["z"], 6)) for r in want.collect()]


def test_state_lets_a_key_through_once_while_it_lives(spark, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    for at in range(3):
        _append(spark, [("a", at, 1.0, 1.0), (f"k{at}", at, 1.0, 1.0)], ROW, source)
    seen = []
    with requests.keyed_state(spark):
        q = pool.first_seen(_stream(spark, ROW, source), "key", "at", 60_000).writeStream.foreachBatch(lambda b, e: seen.extend(r["key"] for r in b.collect()))
        q.option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == ["a", "k0", "k1", "k2"]


@pytest.mark.parametrize("sizes", [[5, 0, 7], [1, 1, 1], [100, 3]])
def test_merged_moments(spark, sizes):
    rows = spark.range(sum(sizes)).select("id", (F.pow(F.col("id") % 11, 3) + 1e6).alias("x"))
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    parts = [pool.moments(rows.where(F.col("id").between(e - n, e - 1)), ["x"]) for n, e in zip(sizes, ends, strict=True)]
    a, b = pool.merged(*parts).first(), pool.moments(rows, ["x"]).first()
    assert a["n"] == b["n"] and abs(a["mean"] - b["mean"]) <= 1e-9 * b["mean"] and abs(a["m2"] - b["m2"]) <= 1e-9 * max(1, b["m2"])
