"""Decisions of a batch as a state machine per company or job.

Proposals are walked in order per key. The state is what the accepted ones before left (a
register name, a status) and the answers given by action id, so a later proposal sees what an
earlier one did, and a repeated action is answered with what the first one got.

A key's walk needs its rows in order, so one task walks a key, row after row from a sorted
stream; it holds the state of one key and one batch of rows. Only a few narrow columns go
through it; the rules and texts of a decision are column expressions.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from licmatch.functions.text import blank

#: What a proposal may do, given the state before: state, wanted value, forced -> allowed.
RULES = {
    # a name is confirmed where there is none, or the same, or the earlier one is superseded
    "resolve": lambda state, wanted, forced: state is None or state == wanted or forced,
    # a status must change
    "move": lambda state, wanted, forced: state != wanted,
    # an application is logged once
    "apply": lambda state, wanted, forced: state in ("", "new"),
}


def _walk(rule: str):
    allowed = RULES[rule]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, accepted, answers = None, None, 0, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.key != at:
                    at, state, accepted, answers = row.key, row.stored, 0, {}
                first = answers.get(row.action) if row.action else None
                out.append((row.ord, state, accepted, first))
                if first is None and row.good and allowed(state, row.wanted, row.forced):
                    state, accepted = row.wanted, accepted + 1
                    if row.action:
                        answers[row.action] = row.ord
            yield pd.DataFrame(out, columns=["_ord", "state_before", "accepted_before",
                                             "repeats"], dtype=object)
    return walk


def with_state(proposals: DataFrame, rule: str, key: str, stored: Column, good: Column,
               wanted: Column, forced: Column | None = None) -> DataFrame:
    """Add ``state_before``, ``accepted_before`` (how many of the key's proposals before were) and
    ``repeats`` (``ord`` of the accepted proposal that this one repeats, or null).

    ``good`` says whether a proposal keeps all rules that don't depend on the state; ``ord``
    is unique in the batch. Proposals repeat each other by ``action_id`` within their key.
    """
    action = blank("action_id") if "action_id" in proposals.columns else F.lit("")
    slim = proposals.select(
        F.col(key).alias("key"), F.col("ord").cast("bigint").alias("ord"),
        action.alias("action"), stored.cast("string").alias("stored"),
        F.coalesce(good, F.lit(False)).alias("good"), wanted.cast("string").alias("wanted"),
        F.coalesce(forced if forced is not None else F.lit(False), F.lit(False))
        .alias("forced")).filter(F.col("key").isNotNull())
    shape = "_ord bigint, state_before string, accepted_before bigint, repeats bigint"

    def walk(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "ord").mapInPandas(
            _walk(rule), shape)
    if rule == "move":
        # What is not in the store cannot move and has no state: no walk, however many proposals
        # name the same missing job.
        walked = walk(slim.filter(F.col("stored").isNotNull())).union(
            slim.filter(F.col("stored").isNull()).select(
                "ord", "stored", F.lit(0).cast("bigint"), F.lit(None).cast("bigint")))
    else:
        walked = walk(slim)
    return proposals.join(walked, F.col("ord") == F.col("_ord"), "left").drop("_ord")


def answered(judged: DataFrame, columns: list[str], zero: list[str],
             log: DataFrame | None = None) -> DataFrame:
    """Give repeats the answer of the first: its code, validations and ``columns``; ``zero`` are 0.

    Repeats of entries that the ``log`` (action_id, id, seq, validations, effects) has get what
    is written there. Adds ``replayed``, and ``log_entry_id`` of the entry in the log.
    """
    same = ["code", "validations", *columns]
    first = judged.filter(F.col("repeats").isNull()).select(
        F.col("ord").alias("_first"), *[F.col(c).alias(f"_{c}") for c in same])
    # Most proposals repeat nothing: they are dealt out by their own order, not all to the
    # partition of a null, and meet no first.
    joined = judged.withColumn("_of", F.coalesce("repeats", F.xxhash64("ord"))).join(
        first, (F.col("_of") == F.col("_first")) & F.col("repeats").isNotNull(), "left")
    again = F.col("_first").isNotNull()
    values = {c: F.when(again, F.col(f"_{c}")).otherwise(F.col(c)) for c in same}
    replayed, entry = again, F.lit(None).cast("string")
    if log is not None:
        kinds = dict(judged.dtypes)
        prior = log.filter(blank("action_id") != "").groupBy("action_id").agg(
            F.max_by(F.struct("id", "validations", "effects"), "seq").alias("_prior"))
        joined = joined.join(prior, "action_id", "left")
        known = F.col("_prior").isNotNull()
        values = {c: F.when(known, _of_entry(c, kinds[c])).otherwise(v)
                  for c, v in values.items()}
        replayed, entry = known | again, F.col("_prior.id")
    values |= {c: F.when(replayed, 0).otherwise(F.col(c)).cast("bigint") for c in zero}
    return joined.withColumns(values | {"replayed": replayed, "log_entry_id": entry}) \
        .select(*judged.columns, "replayed", "log_entry_id")


def _of_entry(column: str, kind: str) -> Column:
    if column == "code":
        return F.lit("")
    if column == "validations":
        return F.col("_prior.validations")
    return F.try_element_at(F.col("_prior.effects"), F.lit(column)).cast(kind)


def not_logged(proposals: DataFrame, log: DataFrame | None) -> Column:
    """Whether the log has no answer to a proposal yet."""
    if log is None:
        return F.lit(True)
    return F.col("_logged").isNull()


def mark_logged(proposals: DataFrame, log: DataFrame | None) -> DataFrame:
    if log is None:
        return proposals
    seen = log.filter(blank("action_id") != "").select(
        "action_id", F.lit(True).alias("_logged")).distinct()
    return proposals.join(seen, "action_id", "left")
