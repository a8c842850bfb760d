"""A captured pool of bounded size, and the drift of its features by moments that are merged, never counted again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from seqspark.operators import metrics
from seqspark.streaming.requests import keyed_state

MOMENTS = "feature string, n long, mean double, m2 double"


class FirstSeen(StatefulProcessor):
    """Lets the first row of a key through; the key is forgotten after its time to live."""

    def __init__(self, order: str, live_ms: int):
        self.order, self.live_ms = order, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.live_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.seen.exists():
            return
        self.seen.update((True,))
        yield pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable").head(1)

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, key: str, order: str, live_ms: int) -> DataFrame:
    """A stream's rows, the first of each key (by ``order`` where several come at once). State holds the keys of the last ``live_ms``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(FirstSeen(order, live_ms), schema, "Append", "ProcessingTime")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _epochs(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """What the micro-batches (before one) have written, with epoch."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("epoch", F.lit(0).cast("long"))
    rows = spark.read.schema(_with_epoch(schema)).parquet(path)
    return rows if before is None else rows.where(F.col("epoch") < before)


def _with_epoch(schema) -> str:
    text = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return f"{text}, epoch long"


def moments(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, n, mean, m2 (the sum of squared deviations) of wide rows."""
    long = metrics.feature_long(rows, [], features)
    return long.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))


def _chan(a: Column, b: Column) -> Column:
    n, apart = a.n + b.n, b["mean"] - a["mean"]
    both = F.struct(n.alias("n"), (a["mean"] + apart * b.n / n).alias("mean"), (a.m2 + b.m2 + apart * apart * a.n * b.n / n).alias("m2"))
    return F.when(a.n == 0, b).when(b.n == 0, a).otherwise(both)


def merged(*parts: DataFrame) -> DataFrame:
    """Moments of the union of what some moments stand for, by Chan's formula."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    known = F.struct("n", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("m2", F.lit(0.0)).alias("m2"))
    held = rows.groupBy("feature").agg(F.array_sort(F.collect_list(known)).alias("parts"))
    return held.select("feature", F.aggregate("parts", nothing, _chan).alias("m")).select("feature", "m.*")


def shift_by_moments(live: DataFrame, bench: DataFrame) -> DataFrame:
    """feature, mu_live, mu_bench, sd_bench, z of two tables of moments: as ``metrics.feature_shift`` over the rows themselves."""
    a = live.select("feature", F.col("mean").alias("mu_live"))
    b = bench.select("feature", F.col("mean").alias("mu_bench"), F.sqrt(F.col("m2") / F.col("n")).alias("sd_bench"))
    return a.join(b, "feature").withColumn("z", F.abs(F.col("mu_live") - F.col("mu_bench")) / (F.col("sd_bench") + 1e-9))


def pool(spark: SparkSession, path: str, schema) -> DataFrame:
    """The captured rows, with the epoch of each."""
    return _epochs(spark, f"{path}/rows", schema)


def newest_moments(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The moments of the whole pool as the latest micro-batch (before one) has left them."""
    rows = _epochs(spark, f"{path}/moments", MOMENTS, before)
    newest = rows.agg(F.max("epoch")).first()[0]
    return rows.where(F.col("epoch") == (-1 if newest is None else newest)).drop("epoch")


def capture(rows: DataFrame, key: str, order: str, path: str, checkpoint: str, cap: int | None = 3000, live_ms: int = 86_400_000, features: list[str] | None = None) -> StreamingQuery:
    """Appends the first row of each key to a pool that never holds more than ``cap`` rows (None: without a bound), in the order of arrival, then of ``order``.

    State forgets a key after ``live_ms``; one that comes again later is still left out while the pool holds it, for the pool is looked up
    too (broadcast where it has a bound, else joined by key). With ``features`` the moments of the pool go on by those of each micro-batch. A micro-batch that is
    replayed counts what came before it and overwrites its own files, so a restart changes nothing.
    """
    spark, schema = rows.sparkSession, rows.schema

    def admit(batch: DataFrame, epoch: int) -> None:
        held = _epochs(spark, f"{path}/rows", schema, epoch).select(F.col(key).alias("_held"))
        if cap is None:
            fresh = batch.join(held, F.col(key) == F.col("_held"), "left_anti")
        else:
            room = cap - held.count()
            if room <= 0:  # the state goes on all the same
                batch.write.format("noop").mode("overwrite").save()
                return
            fresh = batch.join(F.broadcast(held), F.col(key) == F.col("_held"), "left_anti").orderBy(order, key).limit(room)  # at most cap rows are held
        fresh.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        if features:
            new = spark.read.schema(schema).parquet(f"{path}/rows/epoch={epoch}")
            merged(newest_moments(spark, path, epoch), moments(new, features)).coalesce(1).write.mode("overwrite").parquet(f"{path}/moments/epoch={epoch}")

    with keyed_state(spark):
        return first_seen(rows, key, order, live_ms).writeStream.foreachBatch(admit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
