from pyspark.sql import functions as F

from seqspark.streaming import jobs


def test_capture_survives_a_restart(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "key string, x int"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema).coalesce(1).write.parquet(source)
    run = lambda: jobs.capture_job(spark.readStream.schema(schema).parquet(source), "key", sink, mark).start().awaitTermination()
    run()
    spark.createDataFrame([("b", 4), ("c", 5)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(sink)
    assert sorted(r["key"] for r in got.collect()) == ["a", "b", "c"]
    assert jobs.first_captured(got, "key", 2).count() == 2


def test_batches_are_scored_as_units(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "batch_id int, idx int, raw double"
    spark.createDataFrame([(0, i, float(i) if i else None) for i in range(8)] + [(1, 0, 0.3)], schema).coalesce(1).write.parquet(source)
    rows = spark.readStream.schema(schema).parquet(source)
    jobs.score_batches(rows, lambda b: b.withColumn("score", F.col("raw") / 10), sink, mark).start().awaitTermination()
    got = {(r["batch_id"], r["idx"]): r["score"] for r in spark.read.parquet(sink).collect()}
    assert got[(1, 0)] == 0.03 and got[(0, 7)] >= 0.5 and sum(v >= 0.5 for (b, _), v in got.items() if b == 0) == 1


def test_drift_report(spark):
    pool, bench = spark.range(10).select((F.col("id") + 100.0).alias("x"), F.col("id").cast("double").alias("y")), spark.range(10).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    assert jobs.drift_report(pool, bench, ["x", "y"], 1).first()["feature"] == "x"


def test_late_events_are_left_out(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 10:30:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    jobs.event_counts(stream, "ts").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counted").first()["n"] == 2
