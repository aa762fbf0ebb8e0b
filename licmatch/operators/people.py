"""People and contacts: tagging, ranking, upserts and follow-up cadence."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from licmatch import rules
from licmatch.functions import dates
from licmatch.functions import people as fn
from licmatch.functions.text import blank, strip
from licmatch.operators.frames import first_per_key


def tag_people(people: DataFrame) -> DataFrame:
    """Signals, evidence, routes and score from what a person published."""
    tagged = people.withColumn("signals", fn.matched_signals("location", "bio", "name",
                                                             "company")) \
        .withColumn("routes", fn.contact_routes())
    return tagged.withColumn("evidence", fn.signal_evidence(
        "signals", {"location": "location", "bio": "bio", "company": "company"})) \
        .withColumn("score", fn.person_score())


def first_known(found: DataFrame, org: str = "org",
                limit: int = rules.PEOPLE_LIMIT) -> DataFrame:
    """Members before contributors, each login once, bots dropped, cut per organisation.

    ``found`` has org, login, relationship and ord.
    """
    member = F.col("relationship") == "member"
    real = found.filter((blank("login") != "")
                        & (member | ~F.col("login").endswith("[bot]"))) \
        .withColumn("_prio", F.when(member, 0).otherwise(1))
    once = first_per_key(real, [org, "login"], ["_prio", "ord"])
    return first_per_key(once, [org], ["_prio", "ord"], limit).drop("_prio")


def people_order() -> list:
    return [F.desc("score"), F.desc("contributions"), F.lower("login")]


def contact_key(df: DataFrame) -> DataFrame:
    who = F.when(blank("handle") != "", F.col("handle")).otherwise(F.col("name"))
    return df.withColumn("company_key", F.lower(strip("company"))) \
        .withColumn("who_key", F.lower(strip(who)))


def upsert_contacts(updates: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Fold saved contacts into one row per (company, handle or name).

    Blank url, location and name are filled by the first value that has one; routes are
    replaced only by a non-empty list. Job links and notes are sets and lines of their own
    (``contact_jobs``, ``contact_notes``): one contact may collect any number of them.
    """
    rows = updates if base is None else base.unionByName(updates, allowMissingColumns=True)
    keyed = contact_key(rows)

    def first_filled(name: str):
        return F.coalesce(F.min_by(F.when(blank(name) != "", strip(name)),
                                   F.when(blank(name) != "", F.col("ord"))), F.lit(""))
    return keyed.groupBy("company_key", "who_key").agg(
        F.min("ord").alias("first_ord"),
        F.min_by(strip("company"), "ord").alias("company"),
        first_filled("name").alias("name"), F.min_by("source", "ord").alias("source"),
        F.min_by(strip("handle"), "ord").alias("handle"),
        first_filled("url").alias("url"), first_filled("location").alias("location"),
        F.max_by("routes", F.when(F.size("routes") > 0, F.col("ord"))).alias("routes"),
        F.min_by("found_on", "ord").alias("found_on"))


def contact_jobs(updates: DataFrame) -> DataFrame:
    """(contact, job_id, first_ord): each linked job once, in the order it was linked."""
    return contact_key(updates).filter(blank("job_id") != "") \
        .groupBy("company_key", "who_key", "job_id").agg(F.min("ord").alias("first_ord"))


def contact_notes(updates: DataFrame) -> DataFrame:
    """(contact, ord, note): note lines in order."""
    return contact_key(updates).filter(strip("notes") != "") \
        .select("company_key", "who_key", "ord", strip("notes").alias("note"))


def rendered_notes(notes: DataFrame, company: str, who: str) -> DataFrame:
    """The note text of one contact."""
    mine = notes.filter((F.col("company_key") == company.strip().lower())
                        & (F.col("who_key") == who.strip().lower()))
    return mine.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "note"))), lambda n: n["note"]), "\n")
        .alias("notes"))


def contacts_of(contacts: DataFrame, company: str) -> DataFrame:
    return contacts.filter(F.lower(strip("company")) == company.strip().lower())


def due_contacts(contacts: DataFrame, as_of) -> DataFrame:
    """Contacted people due a nudge: the largest cadence step not above the days passed."""
    days = F.date_diff(dates.as_date(as_of), dates.iso_date("contacted_on"))
    step, text = F, F
    for day, what in reversed(rules.CADENCE_STEPS):
        step = step.when(F.col("days") >= day, day)
        text = text.when(F.col("days") >= day, what)
    waiting = contacts.filter(F.col("status") == "contacted").withColumn("days", days)
    return waiting.withColumn("touch", step.otherwise(None)) \
        .withColumn("what_to_send", text.otherwise(None)) \
        .filter(F.col("touch").isNotNull())


def source_groups(companies: DataFrame, people: DataFrame, contacts: DataFrame,
                  role: str | None = None) -> DataFrame:
    """Per company, in long form: found people, prepared searches and saved contacts.

    The three sources are labelled and never ranked against each other.
    """
    key = F.lower(strip("company"))
    names = companies.select("company", key.alias("company_key")).distinct()
    shown = people.select(key.alias("company_key"), F.lit("person").alias("source"),
                          F.col("login").alias("item"), F.col("url").alias("link"))
    saved = contacts.select(key.alias("company_key"), F.lit("saved").alias("source"),
                            F.col("name").alias("item"), F.col("url").alias("link"))
    links = names.select("company", F.inline(fn.search_links(
        "company", F.lit(role) if role else None))) \
        .select("company", F.concat(F.col("kind"), F.lit("-search")).alias("source"),
                F.col("key").alias("item"), F.col("url").alias("link"))
    listed = names.join(shown.unionByName(saved), "company_key") \
        .select("company", "source", "item", "link")
    return listed.unionByName(links)
