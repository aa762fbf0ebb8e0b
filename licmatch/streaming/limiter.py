"""Accepted-only sliding rate limiter.

A hit is admitted when fewer than ``limit`` admitted hits lie within the window before it.
Rejected hits do not count, so the rule is sequential per key; but a gap longer than the
window empties it, so hits split into independent segments wherever such a gap occurs.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from licmatch import rules
from licmatch.operators.frames import carry_forward

_BUCKET_SECONDS = 3600


def segments(hits: DataFrame, window: float) -> DataFrame:
    """Add ``segment``: the time the hit's independent segment started, per key.

    Gaps lie between distinct times, so hits that share a time share a segment. They are found
    inside hour buckets plus one lookup of the bucket before, so no task has to walk the whole
    history of a busy key.
    """
    bucketed = hits.select("key", "at").distinct() \
        .withColumn("_bucket", F.floor(F.col("at") / _BUCKET_SECONDS))
    ends = bucketed.groupBy("key", "_bucket").agg(F.max("at").alias("_last"))
    before = Window.partitionBy("key").orderBy("_bucket")
    earlier = ends.select("key", "_bucket", F.lag("_last").over(before).alias("_earlier"))
    inside = Window.partitionBy("key", "_bucket").orderBy("at")
    marked = bucketed.withColumn("_prev", F.lag("at").over(inside)) \
        .join(earlier, ["key", "_bucket"]) \
        .withColumn("_prev", F.coalesce("_prev", "_earlier")) \
        .withColumn("_start", F.when(
            F.col("_prev").isNull() | (F.col("at") - F.col("_prev") > window),
            F.col("at"))) \
        .withColumn("_pos", F.col("at"))
    carried = carry_forward(marked, ["key"], "_pos", "_start", "segment",
                            chunk=_BUCKET_SECONDS)
    return hits.join(carried.select("key", "at", "segment"), ["key", "at"]) \
        .select(*hits.columns, "segment")


def _admit(limit: int, window: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for batch in batches:
            keep = []
            for key, segment, at in zip(batch["key"], batch["segment"], batch["at"]):
                if (key, segment) != current:
                    current, recent = (key, segment), deque()
                while recent and at - recent[0] > window:
                    recent.popleft()
                allowed = len(recent) < limit
                if allowed:
                    recent.append(at)
                keep.append(allowed)
            yield batch[keep]
    return run


def admitted(hits: DataFrame, limit: int, window: float = rules.RATE_WINDOW_SECONDS
             ) -> DataFrame:
    """The admitted rows of hits(key, at, ord); ``at`` is in seconds.

    Sorted partitions are streamed through with at most ``limit`` times in memory. A segment is
    sequential by its rule (whether a hit counts depends on all before it), so a key that never
    pauses longer than the window is walked by one task; its memory does not grow.
    """
    ordered = segments(hits, window).repartition("key", "segment") \
        .sortWithinPartitions("key", "segment", "at", "ord")
    return ordered.mapInPandas(_admit(limit, window), ordered.schema).select(*hits.columns)
