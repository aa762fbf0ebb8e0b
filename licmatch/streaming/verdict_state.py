"""Liveness verdicts as keyed state with timers.

A dead posting stays dead, a live verdict is dropped three days (of event time) after it was
given, an unknown one is never stored. The state holds one row per id that is dead or live at
the watermark; nothing else grows. Everything runs on event time, so a replay of old probes
gives what the first run gave.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from licmatch import rules

LATENESS = "10 minutes"
CHANGES = "id string, verdict string, at_ms bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class VerdictState(StatefulProcessor):
    """State of one id: dead, or the time of its last live verdict; emits what changes."""

    def __init__(self, ttl_days: int = rules.LIVE_TTL_DAYS):
        self._ttl_ms = ttl_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("verdict", "dead boolean, live_ms bigint")

    def _change(self, key, verdict: str, at: int) -> Row:
        return Row(id=key[0], verdict=verdict, at_ms=at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        died = seen = None
        for row in rows:
            if row.verdict == "dead":
                died = row.at_ms if died is None else min(died, row.at_ms)
            elif row.verdict == "live":
                seen = row.at_ms if seen is None else max(seen, row.at_ms)
        if died is None and seen is None:  # nothing known, no look at the state
            return
        held = self._held.get()
        if held is not None and held[0]:
            return
        before = None if held is None else held[1]
        if died is not None:  # a timer of an earlier live verdict runs out unheard
            self._held.update((True, None))
            yield self._change(key, "dead", died)
        elif before is None or seen > before:
            if seen + self._ttl_ms > timerValues.getCurrentWatermarkInMs():
                self._held.update((False, seen))
                if before is None:
                    self._handle.registerTimer(seen + self._ttl_ms)
                    yield self._change(key, "live", seen)
            else:  # older than its time to live when it came
                self._held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held.get()
        if held is None or held[0]:
            return
        # A live id has one timer, set for its first verdict; later ones move it on here.
        due = held[1] + self._ttl_ms
        if due <= max(expiredTimerInfo.getExpiryTimeInMs(),
                      timerValues.getCurrentWatermarkInMs()):
            self._held.clear()
            yield self._change(key, "expired", due)
        else:
            self._handle.registerTimer(due)

    def close(self) -> None:
        pass


def verdict_changes(probes: DataFrame, ttl_days: int = rules.LIVE_TTL_DAYS) -> DataFrame:
    """Stream of (id, verdict, at_ms): dead, live, and expired when a live one runs out.

    ``probes`` has id, verdict and the time it was checked.
    """
    slim = probes.select(
        "id", "verdict", F.col("checked").cast("timestamp").alias("checked")) \
        .withWatermark("checked", LATENESS) \
        .withColumn("at_ms", F.unix_millis("checked"))
    return slim.groupBy("id").transformWithState(
        VerdictState(ttl_days), CHANGES, "Append", "EventTime")


def run(probes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Drain what is there into ``folder``; state variables need the RocksDB provider."""
    spark = probes.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = verdict_changes(probes).writeStream.format("json") \
            .option("path", folder).option("checkpointLocation", checkpoint) \
            .outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return query


def stored(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(id, verdict, live_ms) as the state store holds it."""
    return spark.read.format("statestore").option("path", checkpoint) \
        .option("stateVarName", "verdict").load().select(
            F.col("key.id").alias("id"),
            F.when(F.col("value.dead"), "dead").otherwise("live").alias("verdict"),
            F.col("value.live_ms").alias("live_ms"))
