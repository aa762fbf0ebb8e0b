"""Engine relations over the derived tables, shared by the registered queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from licmatch.operators import licence, store
from licmatch.plans.fixtures import AS_OF, Tables
from licmatch.sources import feeds

TODAY = AS_OF


def lookup(t: Tables) -> DataFrame:
    return licence.licence_lookup(t.register)


def matched(t: Tables) -> DataFrame:
    """Postings matched against register and alias overlay."""
    return licence.match_companies(t.postings, lookup(t), t.aliases)


def exact_matched(t: Tables) -> DataFrame:
    return licence.match_companies(t.postings, lookup(t))


def judged_feed(t: Tables) -> DataFrame:
    from licmatch.operators import ingest
    board_rows = t.feed.filter(F.col("source") != "adzuna")
    return ingest.judged(board_rows, t.store, TODAY)


def log(t: Tables) -> DataFrame:
    """Structured decision-log entries from the flat log fixture."""
    return t.dlog.select(
        "seq", "id", "action_id", F.col("day").alias("ts"), "type", "rationale",
        F.struct(F.lit("company").alias("kind"), F.upper("company").alias("id"))
        .alias("entity"))


def postings_of(t: Tables, family: str) -> DataFrame:
    return feeds.board_rows(t.fetches.filter(F.col("ats") == family), TODAY)


def updates(t: Tables) -> DataFrame:
    """Contact saves with a routes array."""
    route = F.struct(F.lit("website").alias("kind"), F.col("route_url").alias("value"),
                     F.col("route_url").alias("url"), F.lit("").alias("note"))
    empty = F.filter(F.array(route), lambda _: F.lit(False))
    return t.touches.withColumn("routes", F.when(F.col("route_url") != "", F.array(route))
                                .otherwise(empty)) \
        .withColumn("found_on", F.col("day"))


def conform(rows: DataFrame) -> DataFrame:
    return store.conform(rows, "ord")
