"""A board ingestion run as one plan: map, gate, match, close, cap."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from licmatch import rules
from licmatch.functions import gates
from licmatch.operators import store as st
from licmatch.operators.frames import first_per_key
from licmatch.operators.licence import match_board_rows


def admitted(calls: DataFrame, day: str = "day", order: str = "ord",
             cap: int = rules.BOARD_DAILY_CAP) -> DataFrame:
    """Calls inside the daily budget, first come first served."""
    return first_per_key(calls, [day], [order], cap)


def capped(rows: DataFrame, limit: int | None, order: str = "ord") -> DataFrame:
    """Blast-radius cap: the first N new rows of a run, all of them when unset."""
    return rows if not limit else rows.orderBy(order).limit(limit)


def judged(feed: DataFrame, tracked: DataFrame, as_of) -> DataFrame:
    """Mapped feed rows with the reason they stay out of the store (null = candidate)."""
    flagged = st.tracked_split(feed.withColumn("_gate", gates.drop_reason(as_of)), tracked)
    return flagged.withColumn("drop_reason", F.coalesce(
        "_gate", F.when(F.col("already_tracked"), "already tracked"))) \
        .select(*feed.columns, "drop_reason")


def collapsed(reason="drop_reason"):
    """Per-city variants of the location reason count as one."""
    return F.when(F.col(reason).startswith("not a UK"), "not a UK location") \
        .otherwise(F.col(reason))


def drop_counts(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("drop_reason").isNotNull()) \
        .groupBy(collapsed().alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def board_yield(rows: DataFrame) -> DataFrame:
    """Per company and source: jobs in the feed and candidates kept."""
    return rows.groupBy("source", "company").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("drop_reason").isNull()).alias("kept"))


@dataclass
class IngestRun:
    """Outputs of one run; all lazy, all over the same plan."""
    candidates: DataFrame
    new_rows: DataFrame
    closed: DataFrame
    drops: DataFrame
    yields: DataFrame


def ingest(feed: DataFrame, tracked: DataFrame, boards: DataFrame, lookup: DataFrame,
           aliases: DataFrame | None, fetched_boards: DataFrame, closed: DataFrame | None,
           as_of, max_new: int | None = None) -> IngestRun:
    rows = judged(feed, tracked, as_of)
    kept = rows.filter(F.col("drop_reason").isNull()).drop("drop_reason")
    candidates = capped(match_board_rows(kept, boards, lookup, aliases), max_new)
    return IngestRun(
        candidates=candidates,
        new_rows=st.insert_only(tracked, candidates),
        closed=st.closures(tracked, feed, fetched_boards, closed, as_of),
        drops=drop_counts(rows),
        yields=board_yield(rows))
