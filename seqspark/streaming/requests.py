"""Requests that arrive in pieces: their rows wait in keyed state until the request is whole, then it is ranked once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from seqspark.operators import scores

#: A store that has lists, timers and times to live; and no micro-batches without data, of which a state with timers would have no end.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state by key, with timers and times to live. The session's own settings come back after."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Assembly(StatefulProcessor):
    """Holds the rows of a request until as many different idx are there as it announces, or its time is up."""

    def __init__(self, columns: list[str], schema: str, wait_ms: int):
        self.columns, self.schema, self.wait_ms = columns, schema, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.rows.get()), columns=self.columns)

    def _released(self, rows: pd.DataFrame, whole: bool) -> pd.DataFrame:
        self.rows.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return rows.assign(is_whole=whole)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        rows = pd.concat([f for f in (held, *rows) if len(f)], ignore_index=True)[self.columns].drop_duplicates("idx")
        announced = rows["n_rows"].max()
        if pd.isna(announced) or len(rows) >= announced:
            yield self._released(rows, True)
            return
        if not len(held):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        values = rows.astype(object).where(rows.notna(), None)
        self.rows.put(list(values.itertuples(index=False, name=None)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        if len(held):
            yield self._released(held, False)

    def close(self) -> None:
        pass


def assembled(rows: DataFrame, wait_ms: int = 60_000) -> DataFrame:
    """A stream of batch_id, idx, n_rows (the rows that the request has) and flat columns -> the same and is_whole, all rows of a request in one
    micro-batch. A row that comes again changes nothing; a request without n_rows is whole at once; what is incomplete after ``wait_ms`` goes out
    as it is, and what comes of it later is a request of its own. State is as large as the requests that wait."""
    kept = rows.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    processor = Assembly([f.name for f in kept], schema, wait_ms)
    return rows.groupBy("batch_id").transformWithStateInPandas(processor, f"{schema}, is_whole boolean", "Append", "ProcessingTime")


def score_requests(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, fraction: float = 0.125, wait_ms: int = 60_000) -> StreamingQuery:
    """Scores rows as they arrive (``score`` adds the column and nothing that looks at other rows), assembles each request and ranks it as one unit,
    however it was split; a null score is 0.5. A micro-batch that is replayed overwrites its own files."""

    def ranked(batch: DataFrame, epoch: int) -> None:
        scores.batch_rank(batch, fraction).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    scored = score(rows).withColumn("score", scores.neutral_on_failure(F.col("score")))
    with keyed_state(rows.sparkSession):
        return assembled(scored, wait_ms).writeStream.foreachBatch(ranked).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
