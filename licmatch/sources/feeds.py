"""Board and aggregator payloads: raw text -> jobs -> posting rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from licmatch import rules, schema
from licmatch.functions import dates, gates
from licmatch.functions import text as tx
from licmatch.functions.text import blank, or_else, strip
from licmatch.operators.store import conform


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): one whole payload per file."""
    return spark.read.text(path, wholetext=True) \
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def read_fetch_log(spark: SparkSession, root: str, boards: DataFrame) -> DataFrame:
    """(ats, slug, company, http_status, body, ord) from payload files ``root/ats/slug.json``.

    Company and order come from the board registry; a file of no board there goes by its slug
    and comes after the others.
    """
    files = read_payloads(spark, f"{root.rstrip('/')}/*/*.json")
    named = files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("ats"),
        F.url_decode(F.regexp_extract("path", r"([^/]+)[.]json$", 1)).alias("slug"), "body")
    known = boards.groupBy("ats", "slug").agg(F.min_by("company", "ord").alias("company"),
                                              F.min("ord").alias("ord"))
    return named.join(known, ["ats", "slug"], "left").select(
        "ats", "slug", F.coalesce("company", "slug").alias("company"),
        F.lit(200).alias("http_status"), "body",
        F.coalesce("ord", F.lit(2 ** 62) + F.xxhash64("ats", "slug") % 2 ** 61).alias("ord"))


def fetch_outcome(family: Column | str = "ats", status: Column | str = "http_status",
                  body: Column | str = "body") -> Column:
    """not_found, transient, active or empty for one fetch.

    An answer without the expected shape means there is no such board; an error or a broken
    body says nothing about the board.
    """
    family, status, body = (tx.col(c) for c in (family, status, body))
    parsed = F.try_parse_json(body)
    kind = F.schema_of_variant(parsed)
    jobs_path = F.when(family == "lever", F.lit(0)).otherwise(F.lit(1))
    listed = F.when(jobs_path == 0, F.try_variant_get(parsed, "$", "array<variant>")) \
        .otherwise(F.try_variant_get(parsed, "$.jobs", "array<variant>"))
    count = F.coalesce(F.size(listed), F.lit(0))
    wrong_shape = F.when(family == "lever", ~kind.startswith("ARRAY")) \
        .when(family == "ashby", F.get_json_object(body, "$.jobs").isNull()
              & F.try_variant_get(parsed, "$.jobs", "variant").isNull())
    return F.when(status == 404, "not_found") \
        .when((status != 200) | status.isNull() | parsed.isNull(), "transient") \
        .when(F.coalesce(wrong_shape, F.lit(False)), "not_found") \
        .when(count > 0, "active").otherwise("empty")


def fetch_outcomes(log: DataFrame) -> DataFrame:
    return log.withColumn("outcome", fetch_outcome())


def _jobs(payloads: DataFrame, parsed: Column, keep: list[str]) -> DataFrame:
    return payloads.select(*keep, F.posexplode(parsed).alias("pos", "job"))


def greenhouse_jobs(payloads: DataFrame, body: str = "body", *keep: str) -> DataFrame:
    return _jobs(payloads, F.from_json(body, schema.GREENHOUSE_FEED)["jobs"], list(keep))


def ashby_jobs(payloads: DataFrame, body: str = "body", *keep: str) -> DataFrame:
    return _jobs(payloads, F.from_json(body, schema.ASHBY_FEED)["jobs"], list(keep))


def lever_jobs(payloads: DataFrame, body: str = "body", *keep: str) -> DataFrame:
    return _jobs(payloads, F.from_json(body, schema.LEVER_FEED), list(keep))


def aggregator_jobs(payloads: DataFrame, body: str = "body", *keep: str) -> DataFrame:
    return _jobs(payloads, F.from_json(body, schema.AGGREGATOR_FEED)["results"], list(keep))


def _at(job: Column, path: str, kind: str = "string") -> Column:
    """A field of a job variant; null where it is absent or of another kind."""
    return F.try_variant_get(job, path, kind)


def _first_set(job: Column, *paths: str) -> Column:
    """The first of several fields, as a variant, that is not blank, zero or false."""
    return F.coalesce(*[F.when(~blank(_at(job, p)).isin("", "0", "false"),
                               _at(job, p, "variant")) for p in paths])


def _list(job: Column, path: str) -> Column:
    return F.coalesce(_at(job, path, "array<variant>"), F.array().cast("array<variant>"))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _greenhouse(job: Column) -> dict[str, Column]:
    departments = F.array_join(F.transform(
        F.filter(_list(job, "$.departments"), _is_object),
        lambda d: blank(_at(d, "$.name"))), ", ")
    return {"company_name": _at(job, "$.company_name"), "title": _at(job, "$.title"),
            "location": _at(job, "$.location.name"), "contract": _at(job, "$.employment_type"),
            "category": departments, "url": _at(job, "$.absolute_url"),
            "posted": _first_set(job, "$.first_published", "$.updated_at"),
            "description": _at(job, "$.content"),
            "deadline": _at(job, "$.application_deadline", "variant")}


def _ashby(job: Column) -> dict[str, Column]:
    extra = F.array_join(F.transform(
        _list(job, "$.secondaryLocations"),
        lambda s: blank(F.when(_is_object(s), _at(s, "$.location")).otherwise(_at(s, "$")))),
        ", ")
    location = F.concat_ws("; ", F.nullif(blank(_at(job, "$.location")), F.lit("")),
                           F.nullif(extra, F.lit("")))
    return {"title": _at(job, "$.title"), "location": location,
            "contract": _at(job, "$.employmentType"),
            "category": or_else(_at(job, "$.department"), _at(job, "$.team")),
            "posted": _at(job, "$.publishedAt", "variant"), "url": _at(job, "$.jobUrl"),
            "description": or_else(_at(job, "$.descriptionHtml"),
                                   _at(job, "$.descriptionPlain"))}


def _lever(job: Column) -> dict[str, Column]:
    return {"title": _at(job, "$.text"), "location": _at(job, "$.categories.location"),
            "contract": _at(job, "$.categories.commitment"),
            "category": or_else(_at(job, "$.categories.team"),
                                _at(job, "$.categories.department")),
            "posted": _at(job, "$.createdAt", "variant"),
            "url": or_else(_at(job, "$.hostedUrl"), _at(job, "$.applyUrl")),
            "description": or_else(_at(job, "$.descriptionPlain"), _at(job, "$.description"))}


#: Family to the place of its jobs in a payload and its fields.
FAMILIES = {"greenhouse": ("$.jobs", _greenhouse), "ashby": ("$.jobs", _ashby),
            "lever": ("$", _lever)}


def board_jobs(fetches: DataFrame, *keep: str) -> DataFrame:
    """(ats, keep..., pos, job) over all families: each payload is parsed once, to a variant.

    A family without a mapper fails the job rather than losing its postings.
    """
    path = None
    for place in sorted({place for place, _ in FAMILIES.values()}):
        mine = F.col("ats").isin(*[f for f, (p, _) in FAMILIES.items() if p == place])
        listed = F.try_variant_get(F.col("_payload"), place, "array<variant>")
        path = F.when(mine, listed) if path is None else path.when(mine, listed)
    unknown = F.raise_error(F.concat(F.lit("no mapper for board family "), F.col("ats")))
    jobs = path.otherwise(unknown.cast("array<variant>"))
    parsed = fetches.select("ats", *keep, F.try_parse_json("body").alias("_payload"))
    return parsed.select("ats", *keep, F.posexplode(jobs).alias("pos", "job"))


def job_order(order: str = "ord", place: str = "pos") -> Column:
    """One sortable number of a payload's number, however large, and the place in it."""
    return (F.col(order).cast("decimal(28,0)") * F.lit(2 ** 31) + F.col(place)) \
        .cast("decimal(38,0)")


def board_rows(fetches: DataFrame, as_of, exact: bool = True, listed_only: bool = False,
               with_slug: bool = False) -> DataFrame:
    """All employer-board families of a fetch log (ats, company, body, ord) in one schema, in
    one pass over the payloads.

    ``listed_only`` leaves out the jobs that their board marks as not listed; ``with_slug`` keeps
    the board's slug, which ``match_board_rows`` tells boards apart by.
    """
    slug = ["slug"] if with_slug else []
    jobs = board_jobs(fetches, "company", "ord", *slug).withColumn("ord", job_order())
    job = F.col("job")
    if listed_only:
        jobs = jobs.filter((F.col("ats") != "ashby")
                           | F.coalesce(_at(job, "$.isListed", "boolean"), F.lit(True)))
    fields = {family: read(job) for family, (_, read) in FAMILIES.items()}

    def field(name: str, absent: str = "string") -> Column:
        out = None
        for family, own in fields.items():
            value = own.get(name, F.lit(None).cast(absent))
            out = F.when(F.col("ats") == family, value) if out is None \
                else out.when(F.col("ats") == family, value)
        return out

    names = ["company_name", "title", "location", "contract", "category", "url", "description"]
    prefix = F.create_map(*[F.lit(x) for kv in rules.FAMILY_PREFIXES.items() for x in kv])
    flat = jobs.select(
        "ord", "company", *slug, F.try_element_at(prefix, F.col("ats")).alias("source"),
        strip(_at(job, "$.id")).alias("job_id"), *[field(n).alias(n) for n in names],
        field("posted", "variant").alias("posted"),
        field("deadline", "variant").alias("deadline"))
    row = flat.select(
        "ord", *slug, F.concat("source", F.lit(":"), "job_id").alias("id"),
        strip("title").alias("title"), or_else("company", "company_name").alias("company"),
        strip("location").alias("location"), tx.contract_type("contract").alias("contract_type"),
        F.substring(blank("category"), 1, 60).alias("category"),
        gates.tier_for_title(strip("title")).alias("tier"),
        dates.json_date("posted").alias("posted_date"), blank("url").alias("redirect_url"),
        F.lit(str(as_of)).alias("date_first_seen"), F.lit(rules.DEFAULT_STATUS).alias("status"),
        F.substring(tx.clean_html("description", exact), 1, 2000).alias("description"),
        "source", dates.json_date("deadline").alias("apply_deadline"))
    return conform(row, "ord", *slug)


def aggregator_rows(jobs: DataFrame, as_of, tier: Column | str,
                    keep: list[str] = (), exact: bool = True) -> DataFrame:
    job = F.col("job")
    row = jobs.select(
        *keep, blank(job["id"]).alias("id"), job["title"].alias("title"),
        job["company"]["display_name"].alias("company"),
        job["location"]["display_name"].alias("location"),
        job["salary_min"].alias("salary_min"), job["salary_max"].alias("salary_max"),
        job["contract_type"].alias("contract_type"), job["category"]["label"].alias("category"),
        tx.col(tier).cast("string").alias("tier"),
        F.substring(blank(job["created"]), 1, 10).alias("posted_date"),
        job["redirect_url"].alias("redirect_url"),
        F.lit(str(as_of)).alias("date_first_seen"),
        F.lit(rules.DEFAULT_STATUS).alias("status"),
        tx.clean_snippet(job["description"], exact).alias("description"),
        F.lit(rules.AGGREGATOR_SOURCE).alias("source"))
    return conform(row, *keep)
