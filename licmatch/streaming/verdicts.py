"""Liveness verdicts with their time to live.

A dead posting stays dead, a live verdict holds for some days, an unknown one is never kept.
The fold is a plain keyed aggregate, so the batch and the streaming form are the same code.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from licmatch import rules


def fold(probes: DataFrame) -> DataFrame:
    """(id, dead, live_at) from probes(id, verdict, checked)."""
    return probes.groupBy("id").agg(
        F.max(F.col("verdict") == "dead").alias("dead"),
        F.max(F.when(F.col("verdict") == "live", F.col("checked"))).alias("live_at"))


def merge(folded: DataFrame) -> DataFrame:
    """One row per id from folds of several batches."""
    return folded.groupBy("id").agg(
        F.max("dead").alias("dead"), F.max("live_at").alias("live_at"))


def current(folded: DataFrame, at: str, ttl_days: int = rules.LIVE_TTL_DAYS) -> DataFrame:
    """(id, verdict) that hold at a point in time."""
    now = F.lit(at).cast("timestamp")
    fresh = (now.cast("double") - F.col("live_at").cast("double")) < ttl_days * 86400
    return folded.select("id", F.when(F.col("dead"), "dead").when(fresh, "live")
                         .otherwise("unknown").alias("verdict"))
