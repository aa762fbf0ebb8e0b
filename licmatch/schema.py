"""Schemas of the relations the engine reads and writes.

Dates stay ISO text in the posting row: an undated or oddly dated posting must survive
unchanged, and ISO text still orders and prunes like a date. Gates parse it when needed.
"""
from __future__ import annotations

from pyspark.sql import types as T

S, D, L, I, B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


def strings(*names: str) -> T.StructType:
    return struct(*[(n, S) for n in names])


POSTING = struct(
    ("id", S), ("title", S), ("company", S), ("location", S), ("salary_min", D),
    ("salary_max", D), ("contract_type", S), ("category", S), ("tier", S),
    ("posted_date", S), ("redirect_url", S), ("date_first_seen", S), ("status", S),
    ("sponsor_match", S), ("sponsor_rating", S), ("sponsor_route", S), ("applied_via", S),
    ("date_applied", S), ("notes", S), ("description", S), ("source", S),
    ("apply_deadline", S))
POSTING_FIELDS = POSTING.fieldNames()
SHORTLIST_VIEW_FIELDS = ["id", "title", "company", "location", "tier", "salary_max",
                         "sponsor_rating", "status", "date_applied", "applied_via", "notes",
                         "redirect_url"]

REGISTER_CSV = strings("Organisation Name", "Town/City", "County", "Type & Rating", "Route")
REGISTER = struct(("org", S), ("town_city", S), ("county", S), ("type_rating", S),
                  ("route", S), ("ord", L))
LICENCE = struct(("key", S), ("rating", S), ("ord", L))
BOARD = strings("company", "ats", "slug", "register_name", "status", "last_ok", "notes")
ALIAS_VALUE = strings("register_name", "rating", "confirmed", "actor", "rationale",
                      "log_entry_id")
ALIAS_MAP = T.MapType(S, ALIAS_VALUE)
ALIAS = struct(("company", S), *[(f.name, S) for f in ALIAS_VALUE], ("ord", L))
REJECTION_MAP = T.MapType(S, T.ArrayType(S))
RULING_VALUE = strings("verdict", "reason", "verified")
RULING_FILE = struct(("companies", T.MapType(S, RULING_VALUE)),
                     ("roles", T.MapType(S, RULING_VALUE)))
RULING = struct(("kind", S), ("ruling_key", S), ("verdict", S), ("reason", S),
                ("verified", S), ("ord", L))
CLOSURE_MAP = T.MapType(S, strings("closed_on", "reason"))
CLOSURE = strings("id", "closed_on", "reason")
VERDICT_MAP = T.MapType(S, strings("verdict", "checked", "note"))
VERDICT = struct(("id", S), ("verdict", S), ("checked", T.TimestampType()), ("note", S))
SAVED_SEARCH = struct(("keywords", S), ("location", S), ("distance", I),
                      ("contract_type", S), ("salary_include_unknown", B), ("category", S),
                      ("max_days_old", I), ("tier", S))

NAMED = strings("name")
GREENHOUSE_JOB = struct(
    ("id", S), ("title", S), ("location", NAMED), ("absolute_url", S), ("updated_at", S),
    ("first_published", S), ("application_deadline", S), ("content", S),
    ("departments", T.ArrayType(NAMED)), ("company_name", S), ("employment_type", S))
GREENHOUSE_FEED = struct(("jobs", T.ArrayType(GREENHOUSE_JOB)))
# secondaryLocations elements are objects or bare strings, so they are read as raw JSON.
ASHBY_JOB = struct(
    ("id", S), ("title", S), ("location", S), ("secondaryLocations", T.ArrayType(S)),
    ("jobUrl", S), ("publishedAt", S), ("employmentType", S), ("department", S),
    ("team", S), ("isListed", B), ("descriptionHtml", S), ("descriptionPlain", S))
ASHBY_FEED = struct(("jobs", T.ArrayType(ASHBY_JOB)))
LEVER_JOB = struct(
    ("id", S), ("text", S),
    ("categories", strings("location", "team", "department", "commitment")),
    ("createdAt", S), ("hostedUrl", S), ("applyUrl", S), ("descriptionPlain", S),
    ("description", S))
LEVER_FEED = T.ArrayType(LEVER_JOB)
DISPLAY, LABEL = strings("display_name"), strings("label")
AGGREGATOR_JOB = struct(
    ("id", S), ("title", S), ("company", DISPLAY), ("location", DISPLAY),
    ("category", LABEL), ("created", S), ("salary_min", D), ("salary_max", D),
    ("contract_type", S), ("redirect_url", S), ("description", S))
AGGREGATOR_FEED = struct(("results", T.ArrayType(AGGREGATOR_JOB)))
FETCH_LOG = struct(("ats", S), ("slug", S), ("http_status", I), ("body", S),
                   ("fetched_on", S))

VALIDATION = struct(("rule", S), ("result", S), ("detail", S), ("overridable", B),
                    ("overridden", B), ("override_reason", S))
ACTOR = strings("id", "display_name", "via")
ENTITY = strings("kind", "id")
LOG_ENTRY = struct(
    ("seq", L), ("id", S), ("action_id", S), ("ts", S), ("actor", ACTOR), ("type", S),
    ("entity", ENTITY), ("input", T.MapType(S, S)),
    ("validations", T.ArrayType(VALIDATION)), ("rationale", S),
    ("effects", T.MapType(S, S)), ("before", T.MapType(S, S)), ("after", T.MapType(S, S)),
    ("reversible", B), ("prev_hash", S), ("hash", S))
RESOLUTION = strings("method", "register_name", "rating", "confirmed_by", "confirmed_at",
                     "rationale")
ROUTE = strings("kind", "value", "url", "note")
CONTACT = struct(
    ("id", S), ("company", S), ("name", S), ("source", S), ("handle", S), ("url", S),
    ("location", S), ("signals", T.ArrayType(S)), ("routes", T.ArrayType(ROUTE)),
    ("status", S), ("job_ids", T.ArrayType(S)), ("notes", S), ("found_on", S),
    ("contacted_on", S))
PERSON = struct(
    ("login", S), ("name", S), ("location", S), ("bio", S), ("blog", S), ("company", S),
    ("url", S), ("email", S), ("twitter", S), ("relationship", S), ("contributions", L))
