"""The decision log: digests, chained append, verification, replay."""
from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from licmatch import rules
from licmatch.functions.text import blank
from licmatch.operators import hash_tree
from licmatch.operators.frames import dense_sequence
from licmatch.sources.staging import shared_folder, staged

CHAIN_CHUNK = 256
#: Entries of an unbroken chain that one task sorts and folds at a time.
FOLD_STEP = 2 ** 20


def digest(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.col(text) if isinstance(text, str) else text,
                                             256))


@F.pandas_udf(StringType())
def _line_digest(lines: pd.Series) -> pd.Series:
    def one(line: str) -> str:
        entry = json.loads(line)
        entry.pop("hash", None)
        text = json.dumps(entry, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    return lines.map(one, na_action="ignore")


def line_digest(raw: Column | str) -> Column:
    """Digest of a raw log line: sorted-key JSON without its own hash."""
    return _line_digest(raw)


def canonical(entry: DataFrame, names: list[str]) -> Column:
    """Canonical text of an entry: JSON of the named columns, sorted by name."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def _number(seq: str, chunk: int) -> Column:
    """Number of the chunk that holds a sequence number, from 0."""
    return F.expr(f"(cast(`{seq}` as bigint) - 1) div {chunk}")


def chunk_digests(bodies: DataFrame, body: str, chunk: int) -> DataFrame:
    """(node, digest, entries) per chunk: the digest of its bodies' digests in order."""
    return bodies.select("seq", F.sha2(F.col(body), 256).alias("_digest")) \
        .groupBy(_number("seq", chunk).alias("node")).agg(F.sha2(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "_digest"))),
            lambda e: e["_digest"]), ""), 256).alias("digest"),
            F.count(F.lit(1)).alias("entries"))


def chunk_starts(bodies: DataFrame, body: str, chunk: int, edge: DataFrame | None = None
                 ) -> DataFrame:
    """(_chunk, _start): the link that each chunk of a log begins with.

    It comes from the hash tree over the chunks' digests, so it depends on every entry before
    it; ``edge`` stands for the chunks left of those given (see ``hash_tree``). The digests, one
    row per ``chunk`` entries, are staged: every level of the tree reads them.
    """
    leaves = staged(chunk_digests(bodies, body, chunk))
    depth = hash_tree.depth_for(leaves.agg(F.max("node")).first()[0])
    return hash_tree.starts(leaves, depth, edge).select(
        F.col("node").alias("_chunk"), F.col("start").alias("_start"))


def log_edge(log: DataFrame, body: str = "body", chunk: int = CHAIN_CHUNK,
             edge: DataFrame | None = None) -> DataFrame:
    """Right edge of the tree over the full chunks of a log: a fold per level.

    With ``edge``, the log given only holds entries from the first chunk after that edge on.
    """
    full = staged(chunk_digests(log, body, chunk).filter(F.col("entries") == chunk))
    last = full.agg(F.max("node")).first()[0]
    if last is None:
        return staged(hash_tree.right_edge(full, 1) if edge is None
                      else edge.select("level", "parent", "fold"))
    return staged(hash_tree.right_edge(full, hash_tree.depth_for(last + 1), edge))


def chain(entries: DataFrame, body: str = "body", chunk: int = CHAIN_CHUNK,
          last_seq: Column | None = None, last_hash: Column | None = None,
          open_chunk: DataFrame | None = None, edge: DataFrame | None = None) -> DataFrame:
    """Add prev_hash and hash to entries that carry ``seq`` and their canonical ``body``.

    A hash chain is sequential, so it is cut into chunks of consecutive numbers that are
    folded in parallel from the starts of ``chunk_starts``. ``last_seq`` and ``last_hash``
    continue a log; ``open_chunk`` then has (seq, body) of the entries of its last, unfinished
    chunk and ``edge`` stands for the chunks before it.
    """
    known = entries.select("seq", F.col(body).alias("_body"))
    if open_chunk is not None:
        known = known.unionByName(open_chunk.select("seq", F.col("body").alias("_body")))
    starts = chunk_starts(known, "_body", chunk, edge)
    grouped = entries.withColumn("_chunk", _number("seq", chunk)).groupBy("_chunk").agg(
        F.min("seq").alias("_from"),
        F.array_sort(F.collect_list(F.struct("seq", F.col(body).alias("body"))))
        .alias("_entries")).join(starts, "_chunk")
    if last_seq is not None:
        goes_on = (F.col("_from") == last_seq + 1) & ((F.col("_from") - 1) % chunk != 0)
        grouped = grouped.withColumn("_start", F.when(goes_on, last_hash)
                                     .otherwise(F.col("_start")))
    link = F.struct(F.lit(0).cast("bigint").alias("seq"), F.col("_start").alias("prev_hash"),
                    F.col("_start").alias("hash"))

    def extend(done: Column, entry: Column) -> Column:
        prev = F.element_at(done, -1)["hash"]
        return F.concat(done, F.array(F.struct(
            entry["seq"].alias("seq"), prev.alias("prev_hash"),
            digest(F.concat(prev, F.lit("\n"), entry["body"])).alias("hash"))))
    folded = F.aggregate("_entries", F.array(link), extend)
    links = grouped.select(F.inline(F.slice(folded, 2, F.size(folded))))
    return entries.join(links, "seq")


def _fold(rows: DataFrame, body: str, start: Column) -> DataFrame:
    """``rows`` with prev_hash and hash of a hash chain over them in the order of ``seq``.

    Every hash needs the one before, so the rows are written down in steps of ``FOLD_STEP``
    numbers and folded step after step; only the last hash goes from one to the next. A task
    sorts one step, whatever the length of the chain.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark)
    cut = rows.withColumn("_step", F.expr(f"cast(seq as bigint) div {FOLD_STEP}"))
    cut.repartition("_step").sortWithinPartitions("_step", "seq").write.partitionBy("_step") \
        .parquet(f"{folder}/rows")
    kept = spark.read.schema(cut.schema).parquet(f"{folder}/rows")
    links = "seq bigint, prev_hash string, hash string"

    def fold(batches):
        last = None
        for rows in batches:
            before, after = [], []
            for text, begin in zip(rows["_body"], rows["_begin"]):
                last = begin if last is None else last
                before.append(last)
                last = "sha256:" + hashlib.sha256(f"{last}\n{text}".encode()).hexdigest()
                after.append(last)
            yield pd.DataFrame({"seq": rows["seq"], "prev_hash": before, "hash": after})

    folded = spark.createDataFrame([], links)
    done = []
    for step, in sorted(kept.select("_step").distinct().collect()):
        mine = kept.filter(F.col("_step") == step).select(
            F.col("seq").cast("bigint").alias("seq"), F.col(body).alias("_body"),
            start.alias("_begin"))
        done.append(f"{folder}/links/{step}")
        folded = staged(mine.coalesce(1).sortWithinPartitions("seq").mapInPandas(fold, links),
                        done[-1])
        start = F.lit(folded.agg(F.max_by("hash", "seq")).first()[0])
    if done:
        folded = spark.read.schema(links).parquet(*done)
    return kept.drop("_step").join(folded, "seq")


def append(log: DataFrame, batch: DataFrame, body_columns: list[str], order: str = "ord",
           max_entries: int = 0, chunk: int | None = CHAIN_CHUNK,
           edge: DataFrame | None = None) -> DataFrame:
    """Number and chain a batch behind the log (seq, prev_hash, hash, body); the result is what
    gets appended.

    Of the log only its last entry, its unfinished chunk and ``edge`` (``log_edge``, worked out
    from the log where it is not given) are read.

    ``chunk=None`` continues an unbroken chain: the batch is folded one step of ``FOLD_STEP``
    entries after another, since every hash needs the one before. With
    ``max_entries`` a batch that would pass the cap is refused with an error: no decision is
    left out.
    """
    last_seq = log.select(F.coalesce(F.max("seq"), F.lit(0).cast("bigint"))).scalar()
    last_hash = log.select(F.coalesce(F.max_by("hash", "seq"), F.lit(rules.GENESIS))).scalar()
    numbered = dense_sequence(batch, order, "seq", start=last_seq + 1)
    if max_entries:
        numbered = numbered.withColumn("seq", F.when(
            F.col("seq") <= max_entries, F.col("seq")).otherwise(F.raise_error(F.lit(
                f"the log is full: {max_entries} entries")).cast("bigint")))
    with_id = numbered.withColumn("id", F.substring(F.sha2(F.concat_ws(
        "|", F.col("seq").cast("string"), blank("action_id"), F.col("ts")), 256), 1, 16))
    names = ["seq", "id", *body_columns]
    texted = with_id.withColumn("body", canonical(with_id, names))
    if chunk is None:
        return _fold(texted, "body", last_hash)
    # The entries of the log's last chunk, if it is not full.
    opened = log.filter(_number("seq", chunk) == F.floor(last_seq / chunk)) \
        .select("seq", "body")
    if edge is None:
        edge = log_edge(log, "body", chunk)
    return chain(texted, "body", chunk, last_seq, last_hash, opened, edge)


def verify_chain(log: DataFrame, body: str | None = None, own_digest: str | None = None,
                 chunk: int | None = CHAIN_CHUNK) -> DataFrame:
    """Chain state of every entry: (seq, link_ok, digest_ok).

    Every entry is checked against its predecessor by a join on the number before it, so a
    log of any length is verified in parallel; numbers must begin at 1 and have neither gaps
    nor repeats. Where a chunk begins, the link must follow from all entries before (see
    ``chunk_starts``), for which ``body`` is needed. Either ``body`` (digest = hash of
    previous hash and body) or ``own_digest`` (a column that already holds the recomputed
    digest) says how an entry's hash is formed. ``chunk=None`` is one unbroken chain. Entries
    missing at the very end leave no trace in any chain.
    """
    before = log.groupBy((F.col("seq") + 1).alias("seq")) \
        .agg(F.min("hash").alias("_before"), F.max("hash").alias("_before_max"))
    repeats = log.groupBy("seq").agg((F.count(F.lit(1)) > 1).alias("_repeated"))
    checked = log.join(before, "seq", "left").join(repeats, "seq")
    first = F.col("seq") == 1
    follows = F.col("_before").isNotNull() & (F.col("_before") == F.col("_before_max"))
    if chunk is None:
        expected = F.when(first, F.lit(rules.GENESIS)).otherwise(F.col("_before"))
    else:
        checked = checked.withColumn("_chunk", _number("seq", chunk)) \
            .join(chunk_starts(log, body, chunk), "_chunk", "left")
        expected = F.when((F.col("seq") - 1) % chunk == 0, F.col("_start")) \
            .otherwise(F.col("_before"))
    recomputed = F.col(own_digest) if own_digest else digest(
        F.concat(F.col("prev_hash"), F.lit("\n"), F.col(body)))
    return checked.select(
        "seq",
        (F.col("prev_hash").eqNullSafe(expected) & (first | follows)
         & ~F.col("_repeated")).alias("link_ok"),
        F.col("hash").eqNullSafe(recomputed).alias("digest_ok"))


def chain_report(states: DataFrame) -> DataFrame:
    """One row: chain_ok, broken_at_seq, count."""
    bad = ~(F.col("link_ok") & F.col("digest_ok"))
    return states.agg(
        (~F.coalesce(F.bool_or(bad), F.lit(False))).alias("chain_ok"),
        F.min(F.when(bad, F.col("seq"))).alias("broken_at_seq"),
        F.count(F.lit(1)).alias("count"))


def verify_log(log: DataFrame, body: str | None = None, own_digest: str | None = None,
               chunk: int | None = CHAIN_CHUNK, alias_file: DataFrame | None = None,
               replayed: DataFrame | None = None) -> DataFrame:
    """One row on the whole log: the chain report, how many aliases of the file drift from the
    log or are unknown to it, and whether the projection matches.

    ``alias_drift`` lists those aliases; a file may have any number, so they stay rows.
    """
    drift = unattributed = F.lit(0).cast("bigint")
    if alias_file is not None:
        found = alias_drift(alias_file, replayed)
        drift, unattributed = [found.filter(F.col("finding") == kind)
                               .select(F.count(F.lit(1))).scalar()
                               for kind in ("drift", "unattributed")]
    return chain_report(verify_chain(log, body, own_digest, chunk)) \
        .withColumn("drift", drift).withColumn("unattributed", unattributed) \
        .withColumn("projection_matches_log", F.col("drift") == 0)


def flatten_log(log: DataFrame) -> DataFrame:
    """The columns replay needs, from structured entries."""
    return log.select(
        "seq", "id", "action_id", F.substring("ts", 1, 10).alias("day"), "type",
        F.try_element_at("input", F.lit("company")).alias("company"),
        F.try_element_at("input", F.lit("register_name")).alias("register_name"),
        F.try_element_at("effects", F.lit("rating")).alias("rating"),
        F.try_element_at("input", F.lit("target_log_entry_id")).alias("target_id"),
        F.col("actor.id").alias("actor"), "rationale")


def without_undone(entries: DataFrame) -> DataFrame:
    """Drop the entries a later ``*.undone`` entry points at."""
    undone = entries.filter(blank("type").endswith(rules.UNDO_SUFFIX)) \
        .select(F.col("target_id").alias("id"))
    return entries.join(undone, "id", "left_anti")


def replay_aliases(entries: DataFrame) -> DataFrame:
    """The alias overlay as a fold of the log: last confirm or reject per company wins."""
    votes = without_undone(entries) \
        .filter(F.col("type").isin(rules.CONFIRM, rules.REJECT) & (blank("company") != ""))
    fields = ["register_name", "rating", "day", "actor", "rationale", "id"]
    last = votes.groupBy("company").agg(F.max_by("type", "seq").alias("type"), *[
        F.max_by(f, "seq").alias(f) for f in fields], F.max("seq").alias("ord"))
    return last.filter(F.col("type") == rules.CONFIRM).select(
        "company", blank("register_name").alias("register_name"),
        blank("rating").alias("rating"), F.col("day").alias("confirmed"), "actor",
        "rationale", F.col("id").alias("log_entry_id"), "ord")


def alias_drift(alias_file: DataFrame, replayed: DataFrame) -> DataFrame:
    """(company, finding): in the file but not the log is unattributed; in the log but
    missing or different in the file is drift."""
    disk = alias_file.select("company", F.col("register_name").alias("_disk"),
                             F.lit(True).alias("_in_file"))
    log = replayed.select("company", F.col("register_name").alias("_log"),
                          F.lit(True).alias("_in_log"))
    finding = F.when(F.col("_in_log").isNull(), "unattributed") \
        .when(F.col("_in_file").isNull() | ~F.col("_disk").eqNullSafe(F.col("_log")), "drift")
    return disk.join(log, "company", "full_outer") \
        .select("company", finding.alias("finding")).filter(F.col("finding").isNotNull())


def read_log(log: DataFrame, kind: str | None = None, ident: str | None = None,
             type: str | None = None, before_seq: int | None = None,
             limit: int | None = None) -> DataFrame:
    """Newest entries first, filtered."""
    rows = log
    if kind is not None:
        rows = rows.filter((F.col("entity.kind") == kind) & (F.col("entity.id") == ident))
    if type:
        rows = rows.filter(F.col("type") == type)
    if before_seq is not None:
        rows = rows.filter(F.col("seq") < before_seq)
    rows = rows.orderBy(F.desc("seq"))
    return rows if limit is None else rows.limit(limit)


def latest_per_action(log: DataFrame) -> DataFrame:
    """The newest entry of every action id."""
    return log.filter(blank("action_id") != "").groupBy("action_id").agg(
        F.max_by("id", "seq").alias("id"), F.max("seq").alias("seq"))
