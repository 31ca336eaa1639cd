"""Conversations that are announced once, by keyed state that nothing but its own timer ends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Once(StatefulProcessor):
    """One row for the first message of a key; the state says when it was last heard of, in milliseconds."""

    def __init__(self, keys: list[str], silence: int | None) -> None:
        self.keys, self.silence = keys, silence

    def init(self, handle) -> None:
        self.handle = handle
        self.heard = handle.getValueState("heard", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max((r["__at"] for r in rows if r["__at"] is not None), default=0)
        before = self.heard.get()[0] if self.heard.exists() else None
        if before is None or last > before:
            self.heard.update((last,))
            if self.silence is not None:
                self.handle.registerTimer(last + self.silence)
        if before is None:
            yield Row(**dict(zip(self.keys, key, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # named by Spark
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.heard.exists() and self.heard.get()[0] + self.silence <= at:  # silent since that timer was set
            self.heard.clear()
        return iter(())

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.heard.update((initialState["__at"],))
        if self.silence is not None and initialState["__at"]:
            self.handle.registerTimer(initialState["__at"] + self.silence)

    def close(self) -> None:
        pass


def announce_once(stream: DataFrame, keys: Sequence[str], time: str, known: DataFrame | None = None, forget: timedelta | None = None, delay: str = "0 seconds") -> DataFrame:
    """The keys of a stream, each once: when its first message comes, unless known (a table with keys) has it already.

    However long a gap is and however many batches lie between, a key isn't announced
    again: the state is a number for each key, in RocksDB on the executors and in the
    checkpoint, from which a restart goes on. With forget, a key's own timer drops it when
    the watermark has passed its last message by that much; known keys start that span
    at their time column, or never end without one. Keys that are null are no
    conversations and give nothing.
    """
    spark, keys = stream.sparkSession, list(keys)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # the only one with keyed state; it must be the same at a restart
    there = lambda df: df.where(" and ".join(f"{k} is not null" for k in keys))
    at = F.unix_millis(F.col(time)).alias("__at")
    rows = there(stream)
    rows = (rows.withWatermark(time, delay) if forget else rows).select(*keys, time, at)
    initial = None
    if known is not None:
        since = F.max(F.unix_millis(F.col(time))) if time in known.columns else F.lit(0).cast("long")
        initial = there(known).groupBy(*keys).agg(F.coalesce(since, F.lit(0)).alias("__at")).groupBy(*keys)
    silence = int(forget.total_seconds() * 1000) if forget else None
    processor = _Once(keys, silence)
    return rows.groupBy(*keys).transformWithState(processor, rows.select(*keys).schema, "append", "eventTime" if forget else "none", initial)
