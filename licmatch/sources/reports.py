"""Text reports as rows of lines, and the reader of ticked review files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from licmatch import rules
from licmatch.functions import dates, gates
from licmatch.functions.text import blank, strip
from licmatch.operators.shortlist import apply_shortlist, top_by_salary
from licmatch.operators.views import summary_line

HEADING = r"^###\s+(.+?)\s*$"
TICK = r"^\s*-\s*\[[xX]\]\s*`([^`]+)`"


def shortlist_report(ranked: DataFrame, as_of) -> DataFrame:
    """(rank, block): one markdown block per shortlisted posting, best first.

    ``ranked`` is a top-N result, so ranking it in one task is bounded by N.
    """
    numbered = ranked.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("score"), "ord")))
    direct = F.when(blank("source") == rules.AGGREGATOR_SOURCE, "") \
        .otherwise(" **[direct employer board]**")
    age = dates.age_days(as_of)
    posted = F.when(age.isNotNull(), F.concat(F.lit(" | Posted: "), age.cast("string"),
                                              F.lit("d ago"))).otherwise("")
    lines = [
        F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), blank("title"),
                 F.lit(" — "), blank("company"), direct),
        F.concat(F.lit("- Score: "), F.col("score").cast("string"), F.lit(" ("),
                 F.array_join("reasons", ", "), F.lit(")")),
        F.concat(F.lit("- Location: "), blank("location"), F.lit(" | Tier: "), blank("tier"),
                 F.lit(" | Sponsor: "), blank("sponsor_rating"), posted),
        F.when(gates.clearance_hint() != "",
               "- ⚠️ The posting mentions clearance eligibility. Read it before applying: "
               "SC normally needs five years' UK residency and DV considerably more."),
        F.when(F.col("liveness") == "unknown",
               "- ⚠️ Could not verify this ad is still listed.")
        if "liveness" in ranked.columns else F.lit(None),
        F.when(F.col("ruling_verdict").isNotNull(), F.concat(
            F.lit("- **Prior research ("),
            F.coalesce("ruling_verified", F.lit("?")), F.lit("):** "),
            blank("ruling_reason"))),
        F.concat(F.lit("- URL: "), blank("redirect_url")),
        F.concat(F.lit("- Tracker id: `"), blank("id"), F.lit("`")),
        F.lit("- [ ] triaged   - [ ] packed   - [ ] submitted"),
    ]
    return numbered.select("rank", F.concat_ws("\n", *lines).alias("block"))


def review_blocks(entries: DataFrame) -> DataFrame:
    """(section, company, block): what the review file shows per company.

    Blocks stay rows, so the file is written by as many tasks as there are companies for.
    """
    tiers = F.when(F.size("tiers") > 0, F.concat(F.lit(", tier "),
                                                 F.array_join("tiers", "/"))).otherwise("")
    hits = F.transform("suggestions", lambda s: F.concat(
        F.lit("- [ ] `"), s["register_name"], F.lit("` ("),
        F.when(blank(s["rating"]) != "", s["rating"]).otherwise("no rating"),
        F.lit(", "), s["why"], F.lit(")")))
    lines = F.flatten(F.array(
        F.array(F.concat(F.lit("### "), F.col("company")),
                F.concat(F.lit("*"), F.col("rows").cast("string"),
                         F.lit(" role(s) tracked"), tiers, F.lit("*"))),
        F.transform("tech_titles", lambda t: F.concat(F.lit("  - "), t)), hits))
    section = F.when(F.col("priority"), "worth deciding").otherwise("probably not worth it")
    return entries.select(section.alias("section"), "company",
                          F.array_join(lines, "\n").alias("block"),
                          "priority", "tier_count", "tech_rows")


def write_review(entries: DataFrame, path: str) -> None:
    blocks = review_blocks(entries)
    blocks.orderBy(F.desc("priority"), F.desc("tier_count"), F.desc("tech_rows"),
                   F.lower("company")) \
        .select(F.concat("block", F.lit("\n")).alias("value")).write.mode("overwrite") \
        .text(path)


def read_review_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Review file(s) as (doc, ord, block): records end where the next heading starts, so a
    file of any size is read in splits."""
    raw = spark.read.option("lineSep", "\n### ").text(path)
    heading = F.when(F.col("value").startswith("### "), F.col("value")) \
        .otherwise(F.concat(F.lit("### "), F.col("value")))
    # The text before the first heading of a file is no block.
    return raw.select(F.col("_metadata.file_path").alias("doc"),
                      F.monotonically_increasing_id().alias("ord"),
                      F.when(F.col("_metadata.file_block_start") >= 0, heading)
                      .alias("block")) \
        .filter(~F.col("block").rlike(r"^### #[^#]"))


def split_blocks(texts: DataFrame, text: str, order: str) -> DataFrame:
    """(order, pos, block) of texts that already sit in a table."""
    parts = F.split(text, r"\n(?=###\s)")
    return texts.select(order, F.posexplode(parts).alias("pos", "block"))


def tick_of_block(block: Column | str = "block") -> tuple[Column, Column]:
    """(company, ticked register name) of one block; the first tick wins."""
    block = F.col(block) if isinstance(block, str) else block
    return (F.regexp_extract(block, r"^###\s+(.+?)[ \t]*(?:\n|$)", 1),
            F.regexp_extract(block, "(?m)" + TICK, 1))


def read_ticks(blocks: DataFrame, order: list[str]) -> DataFrame:
    """(company, register_name): ticked boxes; a later heading of the same company wins."""
    company, tick = tick_of_block()
    found = blocks.select(strip(company).alias("company"),
                          strip(tick).alias("register_name"),
                          F.struct(*order).alias("_at")) \
        .filter((F.col("company") != "") & (F.col("register_name") != ""))
    return found.groupBy("company").agg(
        F.max_by("register_name", "_at").alias("register_name"))


def run_summary(new_rows: DataFrame, store: DataFrame) -> DataFrame:
    """(section, ord, line): the text body of a run summary."""
    def section(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), "ord", summary_line().alias("line"))
    shortlist = apply_shortlist(store)
    confirmed = new_rows.filter(F.col("sponsor_match") == "yes")
    others = new_rows.filter(F.col("sponsor_match") != "yes")
    return section("shortlist", shortlist) \
        .unionByName(section("confirmed", confirmed)) \
        .unionByName(section("others", others)) \
        .unionByName(section("top", top_by_salary(store)))
