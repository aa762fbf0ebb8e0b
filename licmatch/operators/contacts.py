"""Saved contacts as a state that merges in any order.

The state is three tables: ``heads`` (a row per contact, each field with the order of the save
it comes from), ``links`` (contact, job) and ``notes`` (contact, line). ``merge`` of two states is
a union and an aggregate with map-side combine; it is associative and commutative, so stored
contacts and any number of batches may be folded as they come, and a contact with any number
of saves, jobs or notes is never one task's group.

A field is filled by the first save that has it, routes are replaced by the last save that has
any, jobs are a set in the order they were linked, note lines are kept in order.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from licmatch.functions.text import blank, strip
from licmatch.schema import CONTACT

KEY = ["company_key", "who_key"]
#: Stored contacts come before all saves.
BEFORE = -2 ** 62
_FILLED = ["name", "url", "location"]
_FIRST = ["id", "company", "source", "handle", "signals", "status", "found_on", "contacted_on"]


@dataclass(frozen=True)
class ContactState:
    heads: DataFrame
    links: DataFrame
    notes: DataFrame


def _keyed(rows: DataFrame) -> DataFrame:
    who = F.when(blank("handle") != "", F.col("handle")).otherwise(F.col("name"))
    return rows.withColumn("company_key", F.lower(strip("company"))) \
        .withColumn("who_key", F.lower(strip(who)))


def _fold(rows: DataFrame) -> DataFrame:
    """Heads from rows of (key, ord, first, name, url, location, routes): structs with their ord."""
    return rows.groupBy(*KEY).agg(
        F.min("ord").alias("ord"), F.min_by("first", "ord").alias("first"),
        *[F.min(F.col(c)).alias(c) for c in _FILLED], F.max("routes").alias("routes"))


def _filled(value: Column, order: Column) -> Column:
    """A value with its order, null where it is blank: the least one is the first filled one."""
    return F.when(value != "", F.struct(order.alias("ord"), value.alias("value")))


def _state(rows: DataFrame, jobs: DataFrame, notes: DataFrame) -> ContactState:
    return ContactState(_fold(rows), jobs.groupBy(*KEY, "job_id").agg(F.min("ord").alias("ord")),
                        notes)


def _routes(order: Column) -> Column:
    # An array cannot be compared with its order in one struct, so it travels as JSON.
    return F.when(F.size("routes") > 0, F.struct(order.alias("ord"),
                                                 F.to_json("routes").alias("value")))


def from_saves(saves: DataFrame, as_of) -> ContactState:
    """State of saves (ord, company, handle, name, source, url, location, job_id, notes, routes[,
    signals, found_on]); an absent day is ``as_of``."""
    rows = _keyed(saves)
    have = set(saves.columns)
    signals = F.coalesce("signals", F.array().cast("array<string>")) if "signals" in have \
        else F.array().cast("array<string>")
    day = blank("found_on") if "found_on" in have else F.lit("")
    name = F.when(strip("name") != "", strip("name")).otherwise(strip("handle"))
    ident = F.substring(F.sha2(F.concat_ws("|", *KEY), 256), 1, 12)
    heads = rows.select(
        *KEY, F.col("ord").cast("bigint").alias("ord"),
        F.struct(ident.alias("id"), strip("company").alias("company"),
                 blank("source").alias("source"), strip("handle").alias("handle"),
                 signals.alias("signals"), F.lit("found").alias("status"),
                 F.when(day != "", day).otherwise(str(as_of)).alias("found_on"),
                 F.lit("").alias("contacted_on")).alias("first"),
        _filled(name, F.col("ord").cast("bigint")).alias("name"),
        *[_filled(strip(c), F.col("ord").cast("bigint")).alias(c) for c in ("url", "location")],
        _routes(F.col("ord").cast("bigint")).alias("routes"))
    order = F.col("ord").cast("bigint").alias("ord")
    return _state(heads,
                  rows.filter(blank("job_id") != "").select(*KEY, "job_id", order),
                  rows.filter(strip("notes") != "").select(*KEY, order, F.lit(0).alias("line"),
                                                           strip("notes").alias("note")))


def from_contacts(contacts: DataFrame) -> ContactState:
    """State of stored contacts (CONTACT, ord): before every save, as they stand."""
    rows = _keyed(contacts).withColumn("ord", F.lit(BEFORE) + F.col("ord").cast("bigint"))
    heads = rows.select(
        *KEY, "ord", F.struct(*[F.col(c) for c in _FIRST]).alias("first"),
        *[_filled(strip(c), F.col("ord")).alias(c) for c in _FILLED],
        _routes(F.col("ord")).alias("routes"))
    jobs = rows.select(*KEY, "ord", F.posexplode("job_ids").alias("at", "job_id")) \
        .select(*KEY, "job_id", (F.lit(-2 ** 63) + F.col("at").cast("bigint")).alias("ord"))
    notes = rows.filter(strip("notes") != "").select(
        *KEY, "ord", F.lit(0).alias("line"), strip("notes").alias("note"))
    return _state(heads, jobs, notes)


def merge(a: ContactState, b: ContactState) -> ContactState:
    """The state of both; which is first doesn't matter."""
    links = a.links.unionByName(b.links)
    return ContactState(_fold(a.heads.unionByName(b.heads)),
                        links.groupBy(*KEY, "job_id").agg(F.min("ord").alias("ord")),
                        a.notes.unionByName(b.notes))


def contacts(state: ContactState) -> DataFrame:
    """The CONTACT rows, every field, with the keys and ``ord``.

    The format lists a contact's jobs and notes in its row; ``links`` and ``notes`` are the form
    for contacts with any number of them.
    """
    jobs = state.links.groupBy(*KEY).agg(F.array_sort(F.collect_list(
        F.struct("ord", "job_id"))).alias("_jobs"))
    notes = state.notes.groupBy(*KEY).agg(F.array_sort(F.collect_list(
        F.struct("ord", "line", "note"))).alias("_notes"))
    routes = F.from_json(F.col("routes.value"), CONTACT["routes"].dataType)
    values = {
        "name": blank("name.value"), "url": blank("url.value"),
        "location": blank("location.value"),
        "routes": F.coalesce(routes, F.array().cast(CONTACT["routes"].dataType)),
        "job_ids": F.coalesce(F.transform("_jobs", lambda j: j["job_id"]),
                              F.array().cast("array<string>")),
        "notes": F.coalesce(F.array_join(F.transform("_notes", lambda n: n["note"]), "\n"),
                            F.lit(""))}
    return state.heads.join(jobs, KEY, "left").join(notes, KEY, "left").select(
        *KEY, "ord", *[values.get(f.name, F.col(f"first.{f.name}")).alias(f.name)
                       for f in CONTACT])
