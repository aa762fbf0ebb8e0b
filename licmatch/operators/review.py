"""The review queue: companies that may hold a licence under another name."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from licmatch.functions import gates
from licmatch.functions.text import blank, normalize_name, strip
from licmatch.operators import licence
from licmatch.operators.frames import count_if, first_per_key
from licmatch.sources.staging import staged

TITLES_SHOWN = 3
REVIEW_TIERS = ["1", "2", "3"]


def _facts(rows: DataFrame) -> DataFrame:
    """Per row what the review needs: company as spelled, ord, tech, review tier, whether it says
    'no', title."""
    name, tier = strip("company"), strip("tier")
    tech = gates.is_tech_role()
    return rows.select(
        name.alias("company"), "ord", tech.alias("tech"),
        F.when(tier.isin(*REVIEW_TIERS), tier).alias("tier"),
        (gates.status_of("sponsor_match") == "no").alias("unmatched"),
        "title")


def _stats(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("company") != "").groupBy("company").agg(
        F.count(F.lit(1)).alias("rows"), count_if(F.col("tech")).alias("tech_rows"),
        F.array_compact(F.array(*[F.when(F.max(F.col("tier") == t), t) for t in REVIEW_TIERS]))
        .alias("tiers"),
        F.min(F.when(F.col("unmatched"), F.col("ord"))).alias("first_no"))


def company_stats(rows: DataFrame) -> DataFrame:
    """Per company as spelled: rows, tech rows, review tiers, whether any row says 'no'."""
    return _stats(_facts(rows))


def _titles(facts: DataFrame) -> DataFrame:
    """The first tech titles of each company, in row order.

    At most three rows per company and task reach the shuffle, so narrowing to the companies
    under review first would only cost a second pass over them.
    """
    top = first_per_key(facts.filter("tech").select("company", "title", "ord"), ["company"],
                        ["ord"], TITLES_SHOWN)
    return top.groupBy("company").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))),
                    lambda t: t["title"]).alias("tech_titles"))


def tech_titles(rows: DataFrame) -> DataFrame:
    """The first tech titles of each company, in row order."""
    return _titles(_facts(rows))


def review_candidates(rows: DataFrame, lookup: DataFrame,
                      aliases: DataFrame | None = None,
                      rejections: DataFrame | None = None) -> DataFrame:
    """Unmatched, undecided, direct employers with at least one suggestion.

    ``suggestions`` holds at most three (register_name, rating, why); of the top three,
    those already rejected for the company are left out. The rank columns order the queue by
    what a decision is worth. The few columns needed of ``rows`` are written down once
    (``staging.staged``): counts and titles read them, and no rule runs twice over the rows.
    """
    facts = staged(_facts(rows))
    waiting = _stats(facts).filter(F.col("first_no").isNotNull()) \
        .filter(~gates.is_agency()).withColumn("key", normalize_name("company"))
    if aliases is not None:
        waiting = waiting.join(licence.alias_keys(aliases).select("key"), "key", "left_anti")
    waiting = staged(waiting)  # a row per company; the suggestions ask for its keys too
    hits = licence.suggest(licence.open_keys(waiting, lookup), lookup)
    if rejections is not None:
        hits = licence.without_rejected(hits, rejections)
    grouped = hits.groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(
            F.struct("rule", "ord", "candidate", "rating", "why"))),
            lambda s: F.struct(s["candidate"].alias("register_name"), s["rating"],
                               s["why"])).alias("suggestions"))
    found = waiting.join(grouped, "key")
    titled = found.join(_titles(facts), "company", "left") \
        .withColumn("tech_titles",
                    F.coalesce("tech_titles", F.array().cast("array<string>")))
    return titled.select(
        "key", "company", "rows", "tiers", "tech_titles", "suggestions",
        (F.col("tech_rows") > 0).alias("priority"), F.size("tiers").alias("tier_count"),
        "tech_rows")


def queue_order() -> list:
    return [F.desc("priority"), F.desc("tier_count"), F.desc("tech_rows"),
            F.lower("company"), "company"]


def numbered_queue(entries: DataFrame) -> DataFrame:
    """Entries with their ``place`` in the queue.

    Places are counted inside groups of equal priority, tiers and tech rows; only the groups,
    one row each, are put in order by one task.
    """
    group = ["priority", "tier_count", "tech_rows"]
    order = [F.desc(c) for c in group]
    sizes = entries.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy(*order)
                                 .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*group, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(F.lower("company"), "company"))
    return entries.withColumn("_inside", inside).join(offsets, group) \
        .withColumn("place", (F.col("_before") + F.col("_inside")).cast("bigint")) \
        .drop("_before", "_inside")


def review_queue(entries: DataFrame) -> DataFrame:
    """One item per normalised company, spellings merged.

    Suggestions depend on the key alone, so every spelling carries the same ones.
    """
    rank = F.struct((~F.col("priority")).alias("p"), (-F.col("tier_count")).alias("t"),
                    (-F.col("tech_rows")).alias("n"), F.lower("company").alias("c"),
                    F.col("company").alias("raw"))
    ranked = entries.withColumn("_rank", rank)
    # A tier set is one of eight, so collecting the distinct sets is bounded.
    merged = ranked.groupBy("key").agg(
        F.min_by("company", F.struct(F.length("company"), "_rank")).alias("company"),
        F.sum("rows").cast("bigint").alias("rows"), F.max("priority").alias("priority"),
        F.min_by("suggestions", "_rank").alias("suggestions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tiers")))).alias("tiers"),
        F.min("_rank").alias("queue_rank"))
    titles = first_per_key(
        ranked.select("key", "_rank", F.posexplode("tech_titles").alias("pos", "title")),
        ["key"], ["_rank", "pos"], TITLES_SHOWN) \
        .groupBy("key").agg(F.transform(F.array_sort(F.collect_list(
            F.struct("_rank", "pos", "title"))), lambda t: t["title"]).alias("tech_titles"))
    return merged.join(titles, "key", "left").select(
        "key", "company", "rows", "tiers",
        F.coalesce("tech_titles", F.array().cast("array<string>")).alias("tech_titles"),
        "priority", "suggestions", "queue_rank")


def confirmations(ticks: DataFrame, lookup: DataFrame, as_of) -> DataFrame:
    """Alias rows for ticked suggestions, rated from the register."""
    known = lookup.select(F.col("key").alias("register_name"), "rating")
    return ticks.join(known, "register_name", "left").select(
        "company", "register_name", blank("rating").alias("rating"),
        F.lit(str(as_of)).alias("confirmed"))


def with_confirmations(overlay: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The alias overlay with confirmations laid in: a company's entry is replaced as a whole."""
    kept = overlay.join(confirmed.select("company"), "company", "left_anti")
    return kept.unionByName(confirmed, allowMissingColumns=True)
