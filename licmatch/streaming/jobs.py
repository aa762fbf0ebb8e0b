"""Structured Streaming jobs over fetch logs, verdict probes and proposed actions.

Writes happen in foreachBatch, each micro-batch being one delta of a table that merges on
read (``sources.delta_store``) and compacts itself. A batch that is run again after a failure
finds its number in the manifest, so results do not change.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from licmatch import rules, schema
from licmatch.operators import ingest as ing
from licmatch.operators import store as st
from licmatch.operators.licence import match_board_rows, match_companies
from licmatch.schema import struct
from licmatch.sources import feeds
from licmatch.sources.delta_store import DeltaStore
from licmatch.sources.staging import staged, staging
from licmatch.sources.tables import append_new
from licmatch.streaming import verdicts

STREAM_FETCH = struct(*[(f.name, f.dataType) for f in schema.FETCH_LOG],
                      ("company", schema.S), ("ord", schema.L))
STORED = struct(*[(f.name, f.dataType) for f in schema.POSTING],
                ("ord", T.DecimalType(38, 0)))
LATENESS = "10 minutes"
#: Deltas after which a stream compacts its table.
COMPACT_AFTER = 16


def read_fetches(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of fetches (ats, slug, company, http_status, body, ord) from JSON lines."""
    return spark.readStream.schema(STREAM_FETCH) \
        .option("maxFilesPerTrigger", files_per_batch).json(path)


def read_batches(spark: SparkSession, root: str, columns: StructType,
                 before: int | None = None) -> DataFrame:
    """Rows of the batch folders written so far, as of a batch number."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch=*/_SUCCESS")
    if not list(pattern.getFileSystem(conf).globStatus(pattern) or []):
        return spark.createDataFrame([], columns)
    with_batch = struct(*[(f.name, f.dataType) for f in columns], ("batch", schema.L))
    rows = spark.read.schema(with_batch).parquet(root)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    return rows.drop("batch")


def posting_store(spark: SparkSession, root: str) -> DeltaStore:
    return DeltaStore(spark, f"{root}/store", STORED)


def closure_store(spark: SparkSession, root: str) -> DeltaStore:
    return DeltaStore(spark, f"{root}/closed", schema.CLOSURE)


def tidy(table: DeltaStore, deltas: int) -> None:
    """Compact a table that has collected so many deltas; readers keep the version before."""
    if len(table.manifest()["deltas"]) >= deltas:
        table.compact()
        table.vacuum(keep=2)


def upsert_stream(rows: DataFrame, root: str, checkpoint: str,
                  compact_after: int = COMPACT_AFTER) -> StreamingQuery:
    """Insert-only upsert of posting rows: each micro-batch is one delta of the store."""
    def each(batch: DataFrame, number: int) -> None:
        table = posting_store(batch.sparkSession, root)
        table.insert(batch, batch=number, stream=checkpoint)
        tidy(table, compact_after)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def close_absent(seen: DataFrame, fetched_boards: DataFrame, root: str, as_of, number: int,
                 stream: str) -> None:
    """Add the closures of one micro-batch: tracked postings that its boards list no more."""
    spark = seen.sparkSession
    tracked, table = posting_store(spark, root).read(), closure_store(spark, root)
    gone = st.closures(tracked, seen, fetched_boards, table.keys(), as_of)
    table.write(puts=gone, batch=number, stream=stream)


def closure_stream(listings: DataFrame, root: str, checkpoint: str, as_of,
                   compact_after: int = COMPACT_AFTER) -> StreamingQuery:
    """Closure by absence over listings (ats, company, id), one row per listed posting.

    A board that lists nothing sends one row without an id. All rows of a board come in one
    micro-batch.
    """
    def each(batch: DataFrame, number: int) -> None:
        close_absent(batch.filter(F.col("id").isNotNull()),
                     batch.select("ats", "company").distinct(), root, as_of, number, checkpoint)
        tidy(closure_store(batch.sparkSession, root), compact_after)

    return listings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def matching_stream(rows: DataFrame, root: str, checkpoint: str,
                    lookup: Callable[[], DataFrame], aliases: Callable[[], DataFrame],
                    compact_after: int = COMPACT_AFTER) -> StreamingQuery:
    """Postings matched as they come; overlay and register are read in every micro-batch."""
    def each(batch: DataFrame, number: int) -> None:
        table = posting_store(batch.sparkSession, root)
        table.insert(match_companies(batch, lookup(), aliases()), batch=number,
                     stream=checkpoint)
        tidy(table, compact_after)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def ingest_stream(fetches: DataFrame, root: str, checkpoint: str, as_of,
                  boards: Callable[[], DataFrame], lookup: Callable[[], DataFrame],
                  aliases: Callable[[], DataFrame], compact_after: int = COMPACT_AFTER
                  ) -> StreamingQuery:
    """Poll results to new postings and closures.

    ``boards``, ``lookup`` and ``aliases`` are called in every micro-batch, so an overlay
    that changed on disk is picked up without a restart. A fetch that failed closes nothing.
    Payloads are parsed once a micro-batch.
    """
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        postings, closed = posting_store(spark, root), closure_store(spark, root)
        with staging(spark) as folder:
            judged = staged(feeds.fetch_outcomes(batch).filter(
                F.col("outcome").isin("active", "empty")), f"{folder}/fetches")
            rows = staged(feeds.board_rows(judged, as_of), f"{folder}/rows")
            kept = ing.judged(rows, postings.keys(), as_of).filter(
                F.col("drop_reason").isNull())
            postings.insert(match_board_rows(kept.drop("drop_reason"), boards(), lookup(),
                                             aliases()), batch=number, stream=checkpoint)
            close_absent(rows, judged.select("ats", "company"), root, as_of, number, checkpoint)
        tidy(postings, compact_after)
        tidy(closed, compact_after)

    return fetches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def distinct_postings(rows: DataFrame, event_time: str) -> DataFrame:
    """Each posting id once, state bounded by the watermark."""
    return rows.withWatermark(event_time, LATENESS).dropDuplicatesWithinWatermark(["id"])


def distinct_actions(actions: DataFrame, event_time: str) -> DataFrame:
    """Repeats of an action id are dropped while the watermark remembers it."""
    return actions.withWatermark(event_time, LATENESS) \
        .dropDuplicatesWithinWatermark(["action_id"])


def daily_decisions(log: DataFrame, event_time: str) -> DataFrame:
    """Tumbling day counts per decision type."""
    return log.withWatermark(event_time, LATENESS) \
        .groupBy(F.window(event_time, "1 day"), "type").agg(F.count(F.lit(1))
                                                            .alias("decisions"))


def board_health(fetches: DataFrame) -> DataFrame:
    """Latest outcome per board; a transient failure changes nothing. Update mode."""
    return feeds.fetch_outcomes(fetches).filter(F.col("outcome") != "transient") \
        .groupBy("ats", "slug").agg(F.max_by("outcome", "ord").alias("outcome"))


def verdict_stream(probes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Fold verdict probes into batch folders; ``read_verdicts`` merges them.

    Every micro-batch adds its own fold, so no state store grows with the number of ids.
    """
    def each(batch: DataFrame, number: int) -> None:
        append_new(verdicts.fold(batch), f"{root}/verdicts", number)

    return probes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


_FOLDED = struct(("id", schema.S), ("dead", schema.B), ("live_at", T.TimestampType()))


def read_verdicts(spark: SparkSession, root: str, at: str) -> DataFrame:
    folded = read_batches(spark, f"{root}/verdicts", _FOLDED)
    return verdicts.current(verdicts.merge(folded), at)


def limit_stream(hits: DataFrame, limit: int,
                 window: float = rules.RATE_WINDOW_SECONDS) -> DataFrame:
    """Streaming form of the accepted-only limiter over hits(key, at, ord).

    The state of a key is the list of admitted times inside the window, at most ``limit``; it is
    dropped when the key has been idle for as long as the window by the clock. The hits of a key
    within one micro-batch are ordered in memory, so the batch size bounds it.
    """
    def admit(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "ord"])
        keep = []
        for at in rows["at"]:
            recent = [t for t in recent if at - t <= window]
            allowed = len(recent) < limit
            if allowed:
                recent.append(at)
            keep.append(allowed)
        state.update((recent,))
        state.setTimeoutDuration(max(1, int(window * 1000)))
        yield rows[keep]

    return hits.groupBy("key").applyInPandasWithState(
        admit, hits.schema, "recent array<double>", "append", "ProcessingTimeTimeout")
