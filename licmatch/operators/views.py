"""Read side: job and company projections, filters, facets, pages and counts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from licmatch import rules
from licmatch.functions import dates, gates
from licmatch.functions.text import as_int, blank, normalize_name, source_of, strip
from licmatch.operators import licence
from licmatch.operators.frames import count_if, first_per_key
from licmatch.operators.search_index import SearchIndex, build, containing

FACETS = ["status", "tier", "source", "sponsor_match"]
TRAIL_LENGTH = 20


def job_summary(rows: DataFrame, as_of, *keep: str) -> DataFrame:
    reason = gates.disqualify()
    return rows.select(
        *keep, "id", "title", "company", "location", "tier", "status",
        source_of("id").alias("source"), "posted_date",
        dates.age_days(as_of).alias("age_days"),
        F.col("salary_max"), "sponsor_match", "sponsor_rating", "redirect_url",
        gates.score(as_of).alias("score"), reason.isNull().alias("eligible"),
        reason.alias("disqualified_reason"))


def decision_trails(log: DataFrame, kind: str, limit: int = TRAIL_LENGTH) -> DataFrame:
    """(entity_id, trail): the newest entries per entity, newest first."""
    rows = log.filter(F.col("entity.kind") == kind) \
        .select(F.col("entity.id").alias("entity_id"), "seq", "type", "rationale")
    newest = first_per_key(rows, ["entity_id"], [F.desc("seq")], limit)
    return newest.groupBy("entity_id").agg(F.sort_array(
        F.collect_list(F.struct("seq", "type", "rationale")), asc=False).alias("trail"))


def job_detail(rows: DataFrame, lookup: DataFrame, aliases: DataFrame, boards: DataFrame,
               log: DataFrame, as_of) -> DataFrame:
    summary = job_summary(rows, as_of, "description", "apply_deadline", "notes",
                          "date_applied", "applied_via",
                          gates.score_reasons(as_of).alias("score_reasons"),
                          gates.clearance_hint().alias("clearance_hint"))
    resolved = licence.resolve(summary, lookup, aliases, boards)
    trails = decision_trails(log, "job").withColumnRenamed("entity_id", "id")
    return resolved.join(trails, "id", "left")


def job_index(jobs: DataFrame, folder: str | None = None) -> SearchIndex:
    """Trigram index over title and company of jobs with an ``id``."""
    return build(jobs.select("id", F.lower(F.concat_ws(" ", "title", "company")).alias("text")),
                 "text", ["id"], folder)


def company_index(companies: DataFrame, folder: str | None = None) -> SearchIndex:
    return build(companies.select("company", F.lower("company").alias("text")), "text",
                 ["company"], folder)


def filter_jobs(jobs: DataFrame, q: str = "", company: str = "", status: str = "",
                tier: str = "", source: str = "", sponsor: str = "",
                eligible: bool | None = None, index: SearchIndex | None = None) -> DataFrame:
    """Conjunction of the supplied filters over job summaries.

    With an ``index`` (``job_index``) the searched text comes from it, not from a scan.
    """
    if q and index is not None:
        jobs = jobs.join(containing(index, q.lower()).select("id"), "id", "left_semi")
    elif q:
        jobs = jobs.filter(F.contains(F.lower(F.concat_ws(" ", "title", "company")),
                                      F.lit(q.lower())))
    for name, value in (("company", company), ("status", status), ("tier", tier),
                        ("source", source), ("sponsor_match", sponsor)):
        if value:
            jobs = jobs.filter(F.col(name) == value)
    if eligible is not None:
        jobs = jobs.filter(F.col("eligible") == eligible)
    return jobs


def facets(jobs: DataFrame) -> DataFrame:
    """(field, value, jobs) for the four facet fields in one pass (grouping sets)."""
    shown = jobs.select(*[F.when(blank(f) == "", "—").otherwise(F.col(f)).alias(f)
                          for f in FACETS])
    sets = shown.groupingSets([[F.col(f)] for f in FACETS], *[F.col(f) for f in FACETS]) \
        .agg(F.count(F.lit(1)).alias("jobs"), F.grouping_id().alias("_set"))
    # The bit of a grouped field is 0, so each set has one known id.
    size = len(FACETS)
    ids = {(2 ** size - 1) ^ (1 << (size - 1 - i)): f for i, f in enumerate(FACETS)}
    field, value = F, F
    for number, name in ids.items():
        field = field.when(F.col("_set") == number, name)
        value = value.when(F.col("_set") == number, F.col(name))
    return sets.select(field.otherwise(None).alias("field"),
                       value.otherwise(None).alias("value"), "jobs")


def paged(rows: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of ordered rows; without a limit all of them from ``offset`` on."""
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def page_total(rows: DataFrame) -> DataFrame:
    """One row: how many rows the pages of a filtered frame have together."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


def job_page(jobs: DataFrame, sort: str = "score", limit: int | None = None,
             offset: int = 0) -> DataFrame:
    """Filtered summaries in order (``ord`` is the last tie break), or one page of them."""
    if sort == "age":
        order = [F.col("age_days").isNull(), F.coalesce("age_days", F.lit(0)), "ord"]
    else:
        order = [F.desc("score"), F.lower("company"), "ord"]
    return paged(jobs.orderBy(*order), limit, offset)


def company_summary(rows: DataFrame, lookup: DataFrame, aliases: DataFrame,
                    boards: DataFrame) -> DataFrame:
    """Per company as spelled: jobs, tech jobs, tiers, agency flag, resolution."""
    tier = strip("tier")
    facts = rows.select(strip("company").alias("company"),
                        gates.is_tech_role().alias("tech"),
                        F.when(tier != "", tier).alias("tier")) \
        .filter(F.col("company") != "")
    grouped = facts.groupBy("company").agg(
        F.count(F.lit(1)).alias("jobs"), count_if(F.col("tech")).alias("tech_jobs"),
        F.array_sort(F.collect_set("tier")).alias("tiers"))
    described = grouped.withColumn("key", normalize_name("company")) \
        .withColumn("is_agency", gates.is_agency())
    return licence.resolve(described, lookup, aliases, boards)


def company_order() -> list:
    return [F.desc("jobs"), F.lower("company"), "company"]


def filter_companies(companies: DataFrame, q: str = "", resolved: bool | None = None,
                     limit: int | None = None, offset: int = 0,
                     index: SearchIndex | None = None) -> DataFrame:
    """Matching companies in order; a page of them if the caller asks for one."""
    if q and index is not None:
        companies = companies.join(containing(index, q.lower()).select("company"), "company",
                                   "left_semi")
    elif q:
        companies = companies.filter(F.contains(F.lower("company"), F.lit(q.lower())))
    if resolved is not None:
        companies = companies.filter((F.col("resolution.method") != "none") == resolved)
    return paged(companies.orderBy(*company_order()), limit, offset)


def company_detail(rows: DataFrame, company: str, lookup: DataFrame, aliases: DataFrame,
                   boards: DataFrame, rejections: DataFrame, log: DataFrame,
                   as_of) -> dict[str, DataFrame]:
    """Everything about one employer. Jobs stay rows: a large employer has many."""
    mine = rows.filter(strip("company") == company)
    summary = company_summary(mine, lookup, aliases, boards)
    keys = licence.open_keys(mine, lookup)
    key = normalize_name(F.lit(company))
    return {
        "summary": summary,
        "suggestions": licence.flag_rejected(licence.suggest(keys, lookup), rejections),
        "jobs": job_summary(mine, as_of),
        "trail": log.filter((F.col("entity.kind") == "company")
                            & (F.col("entity.id") == key))
        .orderBy(F.desc("seq")).limit(TRAIL_LENGTH),
    }


def job_by_id(rows: DataFrame, job_id: str) -> DataFrame:
    return rows.filter(F.col("id") == job_id)


def company_by_key(rows: DataFrame, key: str) -> DataFrame:
    """Rows of the company with this normalised key, whatever case it is typed in."""
    return rows.filter(normalize_name("company") == key.upper())


def overview(rows: DataFrame, decisions_due: Column | int = 0) -> DataFrame:
    """The counts the first screen opens with; one pass."""
    status = gates.status_of()
    sent = status.isin(*rules.SENT_STATUSES)
    declined = status.isin(*rules.DECLINED_STATUSES)
    flags = rows.select(
        sent.alias("sent"), (~sent & declined).alias("declined"),
        (~sent & ~declined & gates.disqualify().isNotNull()).alias("blocked"),
        (status == "applied").alias("waiting"),
        (F.lower(blank("sponsor_match")) == "no").alias("no"))
    due = decisions_due if isinstance(decisions_due, Column) else F.lit(decisions_due)
    return flags.agg(
        F.count(F.lit(1)).alias("tracked"),
        count_if(~F.col("sent") & ~F.col("declined") & ~F.col("blocked"))
        .alias("ready_to_apply"),
        count_if(F.col("sent")).alias("applied"),
        count_if(F.col("waiting")).alias("awaiting_reply"),
        count_if(F.col("blocked")).alias("filtered_out"),
        count_if(F.col("blocked") & F.col("no")).alias("filtered_no_sponsor"),
        count_if(F.col("declined")).alias("not_interested")) \
        .withColumn("needs_a_name_decision", due.cast("bigint"))


def dataset_meta(rows: DataFrame, aliases: DataFrame, lookup: DataFrame) -> DataFrame:
    """Row, company, alias and register entry counts; one row."""
    name = strip("company")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.when(name != "", name)).alias("companies")) \
        .withColumn("aliases", aliases.select(F.count_distinct("company")).scalar()) \
        .withColumn("register_entries", lookup.select(F.count(F.lit(1))).scalar())


def distinct_companies(rows: DataFrame) -> DataFrame:
    return rows.select(strip("company").alias("company")).filter("company <> ''").distinct()


def follow_ups(rows: DataFrame, as_of,
               after_days: int = rules.FOLLOW_UP_AFTER_DAYS) -> DataFrame:
    """Applications gone quiet; one without a date is reported with null days."""
    applied = rows.filter(gates.status_of() == "applied")
    days = F.date_diff(dates.as_date(as_of), dates.iso_date("date_applied"))
    return applied.withColumn("days", days) \
        .filter(F.col("days").isNull() | (F.col("days") >= after_days)) \
        .select("id", "company", "title", strip("date_applied").alias("date_applied"),
                "days", "applied_via", "ord") \
        .orderBy(F.desc_nulls_last("days"), "ord")


def summary_line() -> Column:
    """One line of the run summary."""
    salary = as_int("salary_max")
    money = F.when(salary != 0, F.concat(F.lit("£"), F.format_number(salary, 0))) \
        .otherwise("salary n/a")
    flag = F.when(F.col("sponsor_match") == "yes", F.concat(
        F.lit("[SPONSOR "), F.when(blank("sponsor_rating") != "", F.col("sponsor_rating"))
        .otherwise("?"), F.lit("]"))) \
        .when(F.col("sponsor_match") == "unconfirmed", "[?sponsor]").otherwise("")

    def pad(value: Column, width: int) -> Column:
        return F.when(F.length(value) < width, F.rpad(value, width, " ")).otherwise(value)
    return F.concat(F.lit("  "), pad(flag, 13), F.lit(" T"), blank("tier"), F.lit(" "),
                    pad(money, 12), F.lit(" "), blank("title"), F.lit(" @ "),
                    blank("company"), F.lit(" ("), blank("location"), F.lit(")"))
