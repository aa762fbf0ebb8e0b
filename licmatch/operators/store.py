"""The posting store: load rules, insert-only merge, closures, edits and mutations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from licmatch import rules
from licmatch.functions import gates
from licmatch.functions.text import blank, clean_id, normalize_name, source_of, strip, twin_key
from licmatch.operators.frames import count_if, first_per_key
from licmatch.operators.licence import alias_keys, effective_lookup
from licmatch.schema import POSTING, POSTING_FIELDS


def conform(rows: DataFrame, *keep: str) -> DataFrame:
    """The fixed posting schema: absent columns and nulls become '' (salaries stay null)."""
    have = set(rows.columns)

    def field(f) -> Column:
        if f.dataType.typeName() != "string":
            value = F.col(f.name) if f.name in have else F.lit(None)
            return value.cast(f.dataType).alias(f.name)
        return (blank(F.col(f.name).cast("string")) if f.name in have
                else F.lit("")).alias(f.name)
    return rows.select(*[field(f) for f in POSTING], *keep)


def load_rules(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Stored rows as the engine sees them: clean ids, backfilled source, last id wins."""
    jid = clean_id("id")
    loaded = conform(rows, order).withColumn("id", jid).filter(F.col("id") != "") \
        .withColumn("source", F.when(F.col("source") == "", source_of("id"))
                    .otherwise(F.col("source")))
    return first_per_key(loaded, ["id"], [F.desc(order)])


def insert_only(store: DataFrame, batch: DataFrame, order: str = "ord") -> DataFrame:
    """The rows of a batch that are new to the store; the first of an id in the batch wins.

    Only the store's id column is read. Existing rows are never touched, so appending this
    result is the whole merge.
    """
    fresh = first_per_key(batch.filter(strip("id") != ""), ["id"], [order])
    return fresh.join(store.select("id"), "id", "left_anti").select(*batch.columns)


def merge(store: DataFrame, batch: DataFrame, order: str = "ord") -> DataFrame:
    return store.unionByName(insert_only(store, batch, order), allowMissingColumns=True)


def tracked_split(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Rows with an ``already_tracked`` flag."""
    ids = store.select("id").distinct().withColumn("already_tracked", F.lit(True))
    return rows.join(ids, "id", "left") \
        .withColumn("already_tracked", F.coalesce("already_tracked", F.lit(False)))


def closures(store: DataFrame, feed: DataFrame, fetched_boards: DataFrame,
             closed: DataFrame | None, as_of) -> DataFrame:
    """Tracked postings a successfully fetched board no longer lists.

    ``feed`` holds every id the boards returned, gated out or not. A board that could not be
    fetched closes nothing.
    """
    prefixes = F.create_map(*[F.lit(x) for kv in rules.FAMILY_PREFIXES.items() for x in kv])
    boards = fetched_boards.select(
        F.coalesce(F.try_element_at(prefixes, F.col("ats")), F.col("ats")).alias("_prefix"),
        F.col("company"), F.col("ats").alias("_ats")).distinct()
    tracked = store.filter(F.col("id").contains(":")) \
        .select("id", "company", F.substring_index("id", ":", 1).alias("_prefix"))
    gone = tracked.join(boards, ["_prefix", "company"]) \
        .join(feed.select("id"), "id", "left_anti")
    if closed is not None:
        gone = gone.join(closed.select("id"), "id", "left_anti")
    return gone.select("id", F.lit(str(as_of)).alias("closed_on"),
                       F.concat(F.lit("absent from "), F.col("_ats"), F.lit(" feed"))
                       .alias("reason")).distinct()


def harvest_edits(store: DataFrame, view: DataFrame, order: str = "ord") -> DataFrame:
    """Lay hand edits made on a view over the store.

    A view row finds its store row by id, else by repost key (the last store row with it).
    Blank values and a default status never overwrite; of several view rows for one store
    row the last valid value wins. Adds ``cells_changed``.
    """
    edited = view.select(
        clean_id(strip("id")).alias("_view_id"), F.col(order).alias("_view_ord"),
        twin_key("company").alias("_tc"), twin_key("title").alias("_tt"),
        *[strip(f).alias(f"_{f}") for f in rules.EDITABLE_FIELDS])
    by_key = store.groupBy(twin_key("company").alias("_tc"), twin_key("title").alias("_tt")) \
        .agg(F.max_by("id", order).alias("_key_id"))
    ids = store.select(F.col("id").alias("_view_id"), F.lit(True).alias("_by_id"))
    located = edited.join(ids, "_view_id", "left") \
        .join(by_key, ["_tc", "_tt"], "left") \
        .withColumn("id", F.when(F.col("_by_id"), F.col("_view_id"))
                    .otherwise(F.col("_key_id"))) \
        .filter(F.col("id").isNotNull())

    def valid(field: str) -> Column:
        value = F.col(f"_{field}")
        keep = value != ""
        if field == "status":
            keep = keep & (F.lower(value) != rules.DEFAULT_STATUS)
        return keep

    edits = located.groupBy("id").agg(*[
        F.max_by(F.when(valid(f), F.col(f"_{f}")),
                 F.when(valid(f), F.col("_view_ord"))).alias(f"_{f}")
        for f in rules.EDITABLE_FIELDS])
    joined = store.join(edits, "id", "left")
    changed = sum((F.when(F.col(f"_{f}").isNotNull()
                          & (F.col(f"_{f}") != strip(f)), 1).otherwise(0)
                   for f in rules.EDITABLE_FIELDS), F.lit(0))
    new = {f: F.coalesce(F.when(F.col(f"_{f}") != strip(f), F.col(f"_{f}")), F.col(f))
           for f in rules.EDITABLE_FIELDS}
    return joined.withColumn("cells_changed", changed).withColumns(new) \
        .select(*store.columns, "cells_changed")


def apply_mutations(store: DataFrame, mutations: DataFrame) -> DataFrame:
    """Field-level writes {id, field, value[, ord]}; adds ``changed``.

    Only named fields of named rows change. The last value of a field wins, so an id carries
    at most one value per column, however many mutations arrive.
    """
    order = "ord" if "ord" in mutations.columns else None
    fields = [c for c in POSTING_FIELDS if c in store.columns and c != "id"]
    known = mutations.filter(F.col("field").isin(*fields))
    value = F.max_by("value", order) if order else F.any_value("value")
    latest = known.groupBy("id", "field").agg(value.alias("value"))
    wide = latest.groupBy("id").agg(F.map_from_entries(
        F.collect_list(F.struct("field", "value"))).alias("_m"))
    joined = store.join(wide, "id", "left")

    def patched(name: str) -> Column:
        new = F.try_element_at("_m", F.lit(name))
        return F.coalesce(new.cast(store.schema[name].dataType), F.col(name))

    touched = F.lit(False)
    for name in fields:
        touched = touched | ~patched(name).eqNullSafe(F.col(name))
    return joined.withColumn("changed", touched) \
        .withColumns({f: patched(f) for f in fields}).select(*store.columns, "changed")


def rescore(store: DataFrame, lookup: DataFrame, aliases: DataFrame) -> DataFrame:
    """Restamp the three licence columns of 'no' rows whose company is now aliased."""
    overlay = alias_keys(aliases).select("key")
    known = effective_lookup(lookup, aliases).join(overlay, "key", "left_semi") \
        .select(F.col("key").alias("_key"), F.col("rating").alias("_rating"))
    joined = store.withColumn("_key", normalize_name("company")).join(known, "_key", "left")
    hit = F.col("_rating").isNotNull() & (gates.status_of("sponsor_match") == "no")
    return joined.withColumns({
        "changed": hit,
        "sponsor_rating": F.when(hit, F.col("_rating")).otherwise(F.col("sponsor_rating")),
        "sponsor_route": F.when(hit, rules.SKILLED_WORKER_ROUTE)
        .otherwise(F.col("sponsor_route")),
        "sponsor_match": F.when(hit, "yes").otherwise(F.col("sponsor_match")),
    }).select(*store.columns, "changed")


def company_rows(store: DataFrame, company: str) -> DataFrame:
    """All spellings of one employer."""
    return store.filter(normalize_name("company") == normalize_name(F.lit(company)))


def filtered_untracked(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Per reason, how many unsuitable batch titles are not tracked yet."""
    unsuitable = batch.withColumn("reason", gates.unsuitable_reason()) \
        .filter(F.col("reason").isNotNull())
    return unsuitable.join(store.select("id"), "id", "left_anti") \
        .groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def run_counts(new_rows: DataFrame, store: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: new, confirmed, others, filtered and tracked."""
    new = new_rows.agg(
        F.count(F.lit(1)).alias("new"),
        count_if(F.col("sponsor_match") == "yes").alias("confirmed"),
        count_if(F.col("sponsor_match") != "yes").alias("others"))
    filtered = filtered_untracked(batch, store) \
        .agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint")).scalar()
    before = store.agg(F.count(F.lit(1))).scalar()
    return new.withColumn("filtered", filtered) \
        .withColumn("tracked", F.col("new") + before)
