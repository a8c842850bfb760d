"""Structured Streaming jobs: de-duplicated capture of groups, scoring of each batch as a unit, and the drift check over what is captured."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from seqspark.operators import metrics, scores
from seqspark.sources.io import scratch


def collected(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has made when all that is there has been read, as a table in the shared folder."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "mark")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(replace).option("checkpointLocation", scratch(spark, "mark")).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def captured(groups: DataFrame, key: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """A stream's rows, the first of each key. With a watermark (time column, delay) the keys held are those within it; without, all, as long as
    the checkpoint lives."""
    if watermark:
        return groups.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])
    return groups.dropDuplicates([key])


def capture_job(groups: DataFrame, key: str, path: str, checkpoint: str, watermark: tuple[str, str] | None = None) -> DataStreamWriter:
    """Appends new groups to a Parquet table; a restart goes on from the checkpoint and keeps what it has seen."""
    rows = captured(groups, key, watermark)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)


def first_captured(table: DataFrame, order: str, limit: int = 3000) -> DataFrame:
    """What a pool of bounded size holds: the first ``limit`` of the captured."""
    return table.orderBy(order).limit(limit)


def score_batches(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, fraction: float = 0.125) -> DataStreamWriter:
    """Scores each micro-batch as it arrives. ``score`` adds score to rows of batch_id, idx; ranks are taken within batch_id (the micro-batch where
    there is none); a null score is 0.5. A batch that is replayed overwrites its own files, so the sink holds each once."""

    def one(batch: DataFrame, epoch: int) -> None:
        batch = batch if "batch_id" in batch.columns else batch.withColumn("batch_id", F.lit(epoch))
        out = score(batch).withColumn("score", scores.neutral_on_failure(F.col("score")))
        scores.batch_rank(out, fraction).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def drift_report(pool: DataFrame, bench: DataFrame, features: list[str], top: int = 12) -> DataFrame:
    """The features of captured groups that have shifted most against a benchmark."""
    shift = metrics.feature_shift(metrics.feature_long(pool, [], features), metrics.feature_long(bench, [], features))
    return shift.orderBy(F.desc("z"), "feature").limit(top)


def event_counts(events: DataFrame, time: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts by window and type of a stream of events; late rows beyond the delay are left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
