"""Keyed state of streams: running counters and a seen-set, kept in RocksDB, with event-time expiry.

Each key's state is in one place, whatever the number of its rows, and is read and written once for a key and micro-batch; the
rows of a key come in Arrow batches.  State outlives a query that is started again from its checkpoint.  A key that has had no row
for ``expire`` is forgotten when the watermark has passed its last row by that much; rows that are later than the watermark are
left out, as Structured Streaming does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sieveline.scratch import new_folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"


class Counter(StatefulProcessor):
    """The count of a key's rows so far, and the time of its last one; a row for each key of a micro-batch, and one when it expires."""

    def __init__(self, key: str, expire_ms: int | None) -> None:
        self.key, self.expire_ms = key, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counter", "n long, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, None)
        before = last
        for part in rows:
            n += len(part)
            newest = part["ms"].max()
            last = last if pd.isna(newest) else int(newest) if last is None else max(last, int(newest))
        self.state.update((n, last))
        if self.expire_ms is not None and last is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.expire_ms)
            self.handle.registerTimer(last + self.expire_ms)
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "last_ms": [last], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last = self.state.get()
        self.state.clear()
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "last_ms": [last], "expired": [True]})

    def close(self) -> None:
        pass


class First(StatefulProcessor):
    """The time of a key's first row, once."""

    def __init__(self, key: str, expire_ms: int | None) -> None:
        self.key, self.expire_ms = key, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "first_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = [part["ms"].min() for part in rows]
        if self.state.exists():
            return
        known = [int(x) for x in newest if not pd.isna(x)]
        first = min(known) if known else None
        self.state.update((first,))
        if self.expire_ms is not None and first is not None:
            self.handle.registerTimer(first + self.expire_ms)
        yield pd.DataFrame({self.key: [key[0]], "first_ms": [first]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, key: str, time: str, late: str, expire_s: int | None, processor, fields: str) -> DataFrame:
    kind = dict(events.dtypes)[key]
    rows = events.withWatermark(time, late).select(key, time, F.unix_millis(time).alias("ms"))
    expire = None if expire_s is None else expire_s * 1000
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor(key, expire), outputStructType=f"`{key}` {kind}, {fields}", outputMode="Update", timeMode="EventTime")


def running_counts(events: DataFrame, key: str, time: str = "ts", late: str = "1 day", expire_s: int | None = None) -> DataFrame:
    """(key, n, last_ms, expired) as they change: updates of counters.  Null keys are one key."""
    return _stateful(events, key, time, late, expire_s, Counter, "n long, last_ms long, expired boolean")


def first_seen(events: DataFrame, key: str, time: str = "ts", late: str = "1 day", expire_s: int | None = None) -> DataFrame:
    """(key, first_ms) of each key when it is first seen, and not again until it is forgotten."""
    return _stateful(events, key, time, late, expire_s, First, "first_ms long")


def updates(stream: DataFrame, state: str | None = None, out: str | None = None) -> DataFrame:
    """Run over all that is there; each micro-batch's updates are a part of the result, named by ``batch``.

    A query that is started again with the same folders goes on with the state that the last one left.
    """
    spark: SparkSession = stream.sparkSession
    state, out = state or new_folder(spark, "keyed-state"), out or new_folder(spark, "keyed")

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, PROVIDER)
    try:
        writer = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
        writer.start().awaitTermination()
    finally:
        spark.conf.unset(_SETTING) if before is None else spark.conf.set(_SETTING, before)
    return spark.read.schema(f"{stream.schema.simpleString()[7:-1].replace(':', ' ')}, batch long").parquet(out)


def last_counts(found: DataFrame, key: str) -> DataFrame:
    """The last count of each key of ``updates``, those that have expired left out."""
    last = found.groupBy(key).agg(F.max_by(F.struct("n", "expired"), F.struct("batch", "expired")).alias("x"))
    return last.where("NOT x.expired").select(key, "x.n")
