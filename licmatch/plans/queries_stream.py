"""Registered queries that drain streams over files written from the given tables.

Each writes its input in slices, runs the stream over the first ones, and goes on from the
checkpoint with the later ones. What is returned has been written down; inputs, checkpoints
and tables of the run are deleted.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from licmatch import schema
from licmatch.plans import oracle as o
from licmatch.plans import relations as r
from licmatch.plans.fixtures import AS_OF
from licmatch.plans.registry import query
from licmatch.schema import struct
from licmatch.sources.delta_store import DeltaStore
from licmatch.sources.staging import staged, staging
from licmatch.streaming import jobs, verdict_state

TODAY = AS_OF


def drain(rows: DataFrame, cuts: list, folder: str,
          start: Callable[[DataFrame, int], StreamingQuery]) -> None:
    """Write each cut of ``rows`` as new files and drain the stream over what is new.

    ``start`` gets the stream of all files and the number of the cut.
    """
    spark = rows.sparkSession
    for number, cut in enumerate(cuts):
        rows.filter(cut).write.parquet(f"{folder}/input/slice={number}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/input/slice=*")
        running = start(stream, number)
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()


@query("st2_upsert_drain", """
    SELECT source, count(*) AS rows, sum(ord)::BIGINT AS ords FROM (
        SELECT source, ord FROM store
        UNION ALL SELECT source, ord FROM feed WHERE id NOT IN (SELECT id FROM store)) x
    GROUP BY source""")
def _(t):
    with staging(t.spark) as folder:
        jobs.posting_store(t.spark, folder).write(puts=t.store)
        # Every posting comes twice, in different slices; the first one counts.
        later = t.feed.withColumn("ord", F.col("ord") + 10 ** 9)
        drain(t.feed.unionByName(later), ["ord % 2 = 0 AND ord < 1000000000",
                                          "ord % 2 = 1 OR ord % 3 = 0 AND ord >= 1000000000",
                                          "ord % 3 = 1 AND ord >= 1000000000"], folder,
              lambda rows, _: jobs.upsert_stream(rows, folder, f"{folder}/checkpoint",
                                                 compact_after=2))
        stored = jobs.posting_store(t.spark, folder).read()
        return staged(stored.groupBy("source").agg(F.count(F.lit(1)).alias("rows"),
                                                   F.sum("ord").cast("bigint").alias("ords")))


@query("st3_closure_drain", """
    SELECT s.id, 'absent from ' || b.ats || ' feed' AS reason FROM store s
    JOIN boards b ON b.company = s.company AND s.source <> 'adzuna'
         AND CASE b.ats WHEN 'greenhouse' THEN 'gh' ELSE b.ats END = s.source
    WHERE b.status = 'active' AND s.id NOT IN (SELECT id FROM feed) AND s.ord % 7 <> 0""")
def _(t):
    fetched = t.boards.filter("status = 'active'").select("ats", "company", "ord")
    prefix = F.expr("CASE ats WHEN 'greenhouse' THEN 'gh' ELSE ats END")
    listed = t.feed.select("company", F.col("source").alias("_source"), "id")
    listings = fetched.withColumn("_source", prefix) \
        .join(listed, ["company", "_source"], "left").select("ats", "company", "id", "ord")
    closed = t.store.filter("ord % 7 = 0").select(
        "id", F.lit(TODAY).alias("closed_on"), F.lit("before").alias("reason"))
    with staging(t.spark) as folder:
        jobs.posting_store(t.spark, folder).write(puts=t.store)
        jobs.closure_store(t.spark, folder).write(puts=closed)
        drain(listings, ["ord % 3 = 0", "ord % 3 = 1", "ord % 3 = 2"], folder,
              lambda rows, _: jobs.closure_stream(rows, folder, f"{folder}/checkpoint", TODAY,
                                                  compact_after=3))
        found = jobs.closure_store(t.spark, folder).read()
        return staged(found.filter("reason <> 'before'").select("id", "reason"))


@query("st7_overlay_drain", f"""
    SELECT p.ord, CASE WHEN a.key IS NOT NULL OR l.key IS NOT NULL THEN 'yes' ELSE 'no' END
               AS sponsor_match,
           CASE WHEN a.key IS NOT NULL THEN coalesce(ra.rating, a.rating)
                ELSE coalesce(l.rating, '') END AS sponsor_rating
    FROM (SELECT ord, {o.norm('company')} AS k FROM postings) p
    LEFT JOIN (SELECT *, 0 AS late FROM al WHERE key IN (
                   SELECT {o.norm('company')} FROM aliases WHERE ord % 4 = 0)
               UNION ALL SELECT *, 1 FROM al) a
           ON a.key = p.k AND a.late = CASE WHEN p.ord % 5 < 2 THEN 0 ELSE 1 END
    LEFT JOIN lk l ON l.key = p.k
    LEFT JOIN lk ra ON ra.key = {o.norm('a.register_name')}""")
def _(t):
    with staging(t.spark) as folder:
        lookup = staged(r.lookup(t), f"{folder}/lookup")
        overlay = struct(*[(f.name, f.dataType) for f in t.aliases.schema])

        def start(rows: DataFrame, number: int) -> StreamingQuery:
            # Between the slices somebody confirms the rest of the aliases.
            now = t.aliases if number else t.aliases.filter("ord % 4 = 0")
            now.write.mode("overwrite").json(f"{folder}/overlay")
            return jobs.matching_stream(
                rows, folder, f"{folder}/checkpoint", lambda: lookup,
                lambda: t.spark.read.schema(overlay).json(f"{folder}/overlay"))
        drain(t.postings, ["ord % 5 < 2", "ord % 5 >= 2"], folder, start)
        return staged(jobs.posting_store(t.spark, folder).read()
                      .select(F.col("ord").cast("bigint").alias("ord"), "sponsor_match", "sponsor_rating"))


@query("st4_verdict_state", """
    SELECT id, CASE WHEN dead THEN 'dead' ELSE 'live' END AS verdict,
           CASE WHEN NOT dead THEN epoch_us(live_at) // 1000 END AS live_ms
    FROM (SELECT 'j' || (user_id * 7 + event_id % 9) AS id,
                 bool_or(event_type = 'error') AS dead,
                 max(ts) FILTER (event_type IN ('view', 'click')) AS live_at
          FROM events GROUP BY 1) v
    WHERE dead OR live_at > (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
                            - INTERVAL 3 DAY""")
def _(t):
    probes = t.events.select(
        F.concat(F.lit("j"), (F.col("user_id") * 7 + F.col("event_id") % 9)
                 .cast("string")).alias("id"),
        F.expr("CASE event_type WHEN 'error' THEN 'dead' WHEN 'view' THEN 'live' "
               "WHEN 'click' THEN 'live' ELSE 'unknown' END").alias("verdict"),
        F.col("ts").cast("timestamp").alias("checked"))
    first, last = probes.agg(F.min("checked"), F.max("checked")).first()
    edges = [first + (last - first) * i / 4 for i in range(1, 4)]
    at = F.col("checked")
    cuts = [at < edges[0], (at >= edges[0]) & (at < edges[1]),
            (at >= edges[1]) & (at < edges[2]), at >= edges[2]]
    with staging(t.spark) as folder:
        drain(probes, cuts, folder, lambda rows, _: verdict_state.run(
            rows, f"{folder}/changes", f"{folder}/checkpoint"))
        return staged(verdict_state.stored(t.spark, f"{folder}/checkpoint"))


@query("a16_merge_on_read", """
    SELECT id, CASE WHEN ord % 4 = 0 THEN 'applied' WHEN ord % 2 = 0 THEN 'new' ELSE status
               END AS status, CASE WHEN ord % 3 = 1 THEN 'n' || ord ELSE '' END AS notes
    FROM store""")
def _(t):
    early = t.store.select("id", F.expr("stack(2, 'notes', IF(ord % 3 = 1, concat('n', ord), "
                                        "NULL), 'status', IF(ord % 2 = 0, 'new', NULL)) "
                                        "AS (field, value)"), "ord")
    late = t.store.filter("ord % 4 = 0").select(
        "id", F.lit("status").alias("field"), F.lit("applied").alias("value"), "ord")
    # Of one batch the last value of a field by its order counts.
    twice = late.withColumn("value", F.lit("ignored")).withColumn("ord", F.col("ord") - 1)
    with staging(t.spark) as folder:
        table = DeltaStore(t.spark, f"{folder}/store", schema.POSTING, buckets=8)
        table.write(puts=t.store)
        table.compact()
        table.write(patches=early.filter("value IS NOT NULL"))
        table.write(patches=late.unionByName(twice))
        return staged(table.read().select("id", "status", "notes"))


@query("s12_compacted_store", """
    SELECT id, title, company, salary_max,
           CASE WHEN ord % 3 = 0 THEN 'closed' WHEN ord % 2 = 0 THEN 'applied'
                ELSE status END AS status
    FROM postings""")
def _(t):
    def moved(rows: DataFrame, status: str) -> DataFrame:
        return rows.select("id", F.lit("status").alias("field"), F.lit(status).alias("value"))

    with staging(t.spark) as folder:
        table = DeltaStore(t.spark, f"{folder}/store", schema.POSTING, buckets=8)
        table.insert(r.conform(t.store))
        table.write(patches=moved(t.store.filter("ord % 2 = 0"), "applied"))
        table.compact()
        table.insert(r.conform(t.postings))  # those of the store are there already
        late = t.postings.filter("ord % 2 = 0").join(t.store.select("id"), "id", "left_anti")
        table.write(patches=moved(late, "applied"))
        table.write(patches=moved(t.postings.filter("ord % 3 = 0"), "closed"))
        table.compact()
        table.vacuum()
        return staged(table.read().select("id", "title", "company", "salary_max", "status"))
