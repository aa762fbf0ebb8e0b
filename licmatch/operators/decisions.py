"""Decisions as batch jobs: one row is one proposed decision.

Proposals are judged against one snapshot and, where they concern the same company or job, in
their order, each meeting what the accepted ones before it left; a repeated action gets the
answer of the first (``decision_fold``). The result of judging is what a preview shows; applying it only turns the accepted rows into mutations and log rows, so a preview
cannot differ from its apply.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from licmatch import rules
from licmatch.functions import dates, gates
from licmatch.functions.text import append_note, blank, normalize_name, strip
from licmatch.operators.decision_fold import answered, mark_logged, not_logged, with_state
from licmatch.operators.frames import count_if, first_per_key
from licmatch.operators.licence import alias_keys
from licmatch.schema import VALIDATION



def _check(rule: str, result: str, detail: Column | str = "", overridable: bool | None = None,
           override: Column | None = None) -> Column:
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return F.struct(
        F.lit(rule).alias("rule"), F.lit(result).alias("result"), text.alias("detail"),
        F.lit(overridable).cast("boolean").alias("overridable"),
        F.lit(True if override is not None else None).cast("boolean").alias("overridden"),
        (override if override is not None else F.lit(None)).cast("string")
        .alias("override_reason"))


def passed(rule: str, detail: Column | str = "") -> Column:
    return _check(rule, "pass", detail)


def failed(rule: str, detail: Column | str, overridable: bool = False) -> Column:
    return _check(rule, "fail", detail, overridable)


def overridden(rule: str, detail: Column | str, reason: Column) -> Column:
    return _check(rule, "fail", detail, None, reason)


class _Rules:
    """Rules in order. The first that fails gives the code; what was checked up to there is
    kept in ``validations``."""

    def __init__(self):
        self.steps: list[tuple[Column, str, Column, Column | None, bool]] = []

    def step(self, failing: Column, code: str, good: Column, bad: Column | None = None,
             keep: bool = True) -> "_Rules":
        self.steps.append((F.coalesce(failing, F.lit(False)), code, good, bad, keep))
        return self

    def code(self) -> Column:
        chain = F
        for failing, code, *_ in self.steps:
            chain = chain.when(failing, code)
        return chain.otherwise("")

    def validations(self) -> Column:
        none = no_validations()
        so_far: list[Column] = []
        chain = F
        for failing, _, good, bad, keep in self.steps:
            shown = [*so_far, *([bad] if bad is not None else [])] if keep else []
            chain = chain.when(failing, F.array(*shown) if shown else none)
            so_far.append(good)
        return chain.otherwise(F.array(*so_far))


def no_validations() -> Column:
    return F.array().cast(f"array<{VALIDATION.simpleString()}>")


def rationale_check(rationale="rationale") -> tuple[Column, Column]:
    """(failing, passed validation) for the length rule of a decision's reason."""
    length = F.length(strip(rationale))
    return (~length.between(rules.MIN_RATIONALE, rules.MAX_RATIONALE),
            passed("rationale_present", F.concat(length.cast("string"), F.lit(" chars"))))


def replay(proposals: DataFrame, log: DataFrame) -> DataFrame:
    """Split off repeats: ``prior_entry`` is the id of the entry that already answered the
    action, from the log or from an earlier proposal of the same batch."""
    prior = log.filter(blank("action_id") != "").groupBy("action_id") \
        .agg(F.max_by("id", "seq").alias("prior_entry"))
    first = proposals.filter(blank("action_id") != "").groupBy("action_id") \
        .agg(F.min("ord").alias("_first"))
    return proposals.join(prior, "action_id", "left").join(first, "action_id", "left") \
        .withColumn("replayed", F.col("prior_entry").isNotNull()
                    | F.coalesce(F.col("_first") < F.col("ord"), F.lit(False))) \
        .drop("_first")


# --- resolve company ----------------------------------------------------------------------

def judge_resolutions(proposals: DataFrame, store: DataFrame, lookup: DataFrame,
                      aliases: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Proposals (ord, company, register_name, rationale, supersede, acknowledge_agency[,
    action_id]) with code ('' = accepted), validations, rating, rows_changed, shortlist_delta,
    replayed and log_entry_id.

    Proposals for one company are judged in their order: a later one meets the name that the
    accepted ones before left, and counts only rows that are still open.
    """
    keyed = mark_logged(proposals, log).withColumn("key", normalize_name("company")) \
        .withColumn("_register_key", normalize_name("register_name"))
    asked = keyed.select("key").distinct()
    undecided = gates.status_of("sponsor_match") != "yes"
    eligible_after = gates.disqualify(sponsor_match=F.lit("yes")).isNull()
    stats = store.withColumn("key", normalize_name("company")) \
        .join(asked, "key", "left_semi").groupBy("key").agg(
            F.count(F.lit(1)).alias("_tracked"), count_if(undecided).alias("_restamped"),
            count_if(undecided & eligible_after).alias("_delta"))
    entries = lookup.select(F.col("key").alias("_register_key"), F.col("rating").alias("_r"))
    existing = alias_keys(aliases).select("key", F.col("register_name").alias("_resolved"))
    joined = keyed.join(stats, "key", "left").join(entries, "_register_key", "left") \
        .join(existing, "key", "left")

    agency = gates.is_agency()
    bad_reason, reason_ok = rationale_check()
    good = F.col("_tracked").isNotNull() & F.col("_r").isNotNull() \
        & (~agency | F.col("acknowledge_agency")) & ~bad_reason & not_logged(keyed, log)
    joined = with_state(joined, "resolve", "key", F.col("_resolved"), good,
                        F.col("register_name"), F.col("supersede")) \
        .withColumn("_resolved", F.col("state_before"))
    resolved = F.col("_resolved").isNotNull() & (F.col("_resolved") != F.col("register_name"))
    entry_ok = passed("register_entry_exists", F.concat(
        F.col("register_name"), F.lit(" ("),
        F.when(blank("_r") != "", F.col("_r")).otherwise("no"),
        F.lit(f" rating, {rules.SKILLED_WORKER_ROUTE})")))
    superseded = F.when(resolved, overridden(
        "not_already_resolved", F.concat(F.lit("superseding "), F.col("_resolved")),
        F.col("rationale"))).otherwise(passed("not_already_resolved"))
    acknowledged = F.when(agency, overridden("not_an_agency", F.col("company"),
                                             F.col("rationale"))) \
        .otherwise(passed("not_an_agency"))
    steps = _Rules() \
        .step(F.col("_tracked").isNull(), "not_found",
              passed("company_is_tracked",
                     F.concat(F.col("_tracked").cast("string"), F.lit(" row(s)"))),
              keep=False) \
        .step(F.col("_r").isNull(), "register_entry_not_found", entry_ok,
              failed("register_entry_exists", F.col("register_name"))) \
        .step(resolved & ~F.col("supersede"), "already_resolved", superseded,
              failed("not_already_resolved", F.col("_resolved"), overridable=True)) \
        .step(agency & ~F.col("acknowledge_agency"), "agency_company", acknowledged,
              failed("not_an_agency", F.col("company"), overridable=True)) \
        .step(bad_reason, "rationale_required", reason_ok, keep=False)
    first = (F.col("code") == "") & (F.col("accepted_before") == 0)
    judged = joined.withColumn("code", steps.code()) \
        .withColumn("validations", steps.validations()) \
        .withColumn("rating", F.when(F.col("code") == "", F.col("_r")).otherwise("")) \
        .withColumn("rows_changed", F.when(first, F.col("_restamped")).otherwise(F.lit(0))) \
        .withColumn("shortlist_delta", F.when(first, F.col("_delta")).otherwise(F.lit(0))) \
        .select(*proposals.columns, "key", "code", "validations", "rating", "rows_changed",
                "shortlist_delta", "repeats")
    return answered(judged, ["rating", "shortlist_delta"], ["rows_changed"], log) \
        .drop("repeats")


def resolution_mutations(judged: DataFrame, store: DataFrame) -> DataFrame:
    """(id, field, value, ord) of the accepted resolutions: the first one of a company stamps its
    open rows, and there are none left for a later one."""
    accepted = first_per_key(_new(judged), ["key"], ["ord"]) \
        .select("key", F.col("rating").alias("_rating"), F.col("ord").alias("_decision"))
    rows = store.filter(gates.status_of("sponsor_match") != "yes") \
        .select("id", normalize_name("company").alias("key")).join(accepted, "key")
    return rows.select("id", F.col("_decision").alias("ord"), F.explode(F.create_map(
        F.lit("sponsor_match"), F.lit("yes"), F.lit("sponsor_rating"), F.col("_rating"),
        F.lit("sponsor_route"), F.lit(rules.SKILLED_WORKER_ROUTE))).alias("field", "value"))


def resolution_changes(judged: DataFrame, store: DataFrame) -> DataFrame:
    """(ord, id, title, before, after): the rows each accepted resolution changes."""
    accepted = first_per_key(_new(judged), ["key"], ["ord"]).select("key", "ord")
    return store.filter(gates.status_of("sponsor_match") != "yes") \
        .select("id", "title", normalize_name("company").alias("key"),
                F.col("sponsor_match").alias("before")).join(accepted, "key") \
        .select("ord", "id", "title", "before", F.lit("yes").alias("after"))


def accepted_aliases(judged: DataFrame, as_of, actor: str = "") -> DataFrame:
    """Overlay rows of the accepted resolutions."""
    return _new(judged).select(
        "company", "register_name", "rating", F.lit(str(as_of)).alias("confirmed"),
        F.lit(actor).alias("actor"), strip("rationale").alias("rationale"),
        F.lit("").alias("log_entry_id"), "ord")


# --- log application ----------------------------------------------------------------------

def judge_applications(proposals: DataFrame, store: DataFrame, as_of,
                       log: DataFrame | None = None) -> DataFrame:
    """Proposals (ord, job_id, applied_via, date_applied, notes, override_reason[, action_id]),
    judged one after another per job; one that breaks a rule by itself is told that rule."""
    facts = store.select(
        F.col("id").alias("job_id"), F.col("title").alias("_title"),
        gates.status_of().alias("_status"), gates.disqualify().alias("_reason"))
    joined = mark_logged(proposals, log).join(facts, "job_id", "left")
    today = dates.as_date(as_of)
    when = strip(F.when(blank("date_applied") != "", F.col("date_applied"))
                 .otherwise(today.cast("string")))
    day = dates.iso_date(when)
    override = strip("override_reason")
    known_method = F.coalesce(F.col("applied_via").isin(*rules.APPLY_METHODS), F.lit(False))
    late = day.isNull() | (day > today)
    barred = F.col("_reason").isNotNull() & (override == "")
    good = F.col("_status").isNotNull() & known_method & ~late & ~barred \
        & not_logged(joined, log)
    joined = with_state(joined, "apply", "job_id", F.col("_status"), good, F.lit("applied")) \
        .withColumn("_status", F.when(good, F.col("state_before")).otherwise(F.col("_status")))
    eligible = F.when(F.col("_reason").isNotNull(),
                      overridden("eligible_to_apply", F.col("_reason"), override)) \
        .otherwise(passed("eligible_to_apply"))
    steps = _Rules() \
        .step(F.col("_status").isNull(), "not_found", passed("job_exists", blank("_title")),
              keep=False) \
        .step(~F.col("_status").isin("", rules.DEFAULT_STATUS), "already_actioned",
              passed("not_already_actioned"),
              failed("not_already_actioned", F.col("_status"))) \
        .step(~known_method, "unknown_method", passed("applied_via_known", F.col("applied_via")),
              keep=False) \
        .step(late, "ineligible", passed("date_not_future", when),
              keep=False) \
        .step(barred, "ineligible", eligible,
              failed("eligible_to_apply", F.col("_reason"), overridable=True))
    judged = joined.withColumn("code", steps.code()) \
        .withColumn("validations", steps.validations()) \
        .withColumn("status_before", F.col("_status")) \
        .withColumn("applied_on", F.when(F.col("code") == "", when).otherwise("")) \
        .withColumn("rows_changed", F.when(F.col("code") == "", 1).otherwise(0)) \
        .select(*proposals.columns, "code", "validations", "status_before", "applied_on",
                "rows_changed", "repeats")
    return answered(judged, ["applied_on"], ["rows_changed"], log).drop("repeats")


def application_mutations(judged: DataFrame) -> DataFrame:
    fields = F.array_compact(F.array(
        F.struct(F.lit("status").alias("field"), F.lit("applied").alias("value")),
        F.struct(F.lit("date_applied").alias("field"), F.col("applied_on").alias("value")),
        F.struct(F.lit("applied_via").alias("field"), F.col("applied_via").alias("value")),
        F.when(strip("notes") != "", F.struct(F.lit("notes").alias("field"),
                                              strip("notes").alias("value")))))
    return _new(judged).select(F.col("job_id").alias("id"), "ord", F.inline(fields))


# --- set status ---------------------------------------------------------------------------

def judge_status_changes(proposals: DataFrame, store: DataFrame, as_of,
                         log: DataFrame | None = None) -> DataFrame:
    """Proposals (ord, job_id, status, note[, action_id]), judged one after another per job.

    The status before a proposal is what the accepted ones before it left, or the store's.
    Dates and notes build on them too.
    """
    before = F.when(gates.status_of() == "", rules.DEFAULT_STATUS).otherwise(gates.status_of())
    facts = store.select(
        F.col("id").alias("job_id"), F.col("title").alias("_title"),
        before.alias("_stored"), strip("date_applied").alias("_applied"),
        F.col("notes").alias("_notes"))
    target = F.lower(strip("status"))
    known = target.isin(*rules.STATUS_VOCAB)
    joined = mark_logged(proposals, log).join(facts, "job_id", "left")
    good = F.col("_stored").isNotNull() & known & not_logged(joined, log)
    joined = with_state(joined, "move", "job_id", F.col("_stored"), good, target).withColumn(
        "status_before", F.when(F.col("_stored").isNotNull(), F.col("state_before")))
    steps = _Rules() \
        .step(F.col("status_before").isNull(), "not_found",
              passed("job_exists", blank("_title")), keep=False) \
        .step(~known, "unknown_status", passed("status_known", target), keep=False) \
        .step(F.col("status_before") == target, "already_actioned",
              passed("status_is_changing",
                     F.concat(F.col("status_before"), F.lit(" -> "), target)),
              failed("status_is_changing", target))
    today = dates.as_date(as_of)
    # One job has few decisions in a batch; those of a job that is not there change nothing and
    # stand alone.
    alone = F.when(F.col("_stored").isNull(), F.col("ord"))
    earlier = Window.partitionBy("job_id", alone).orderBy("ord") \
        .rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("job_id", alone).orderBy("ord") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    accepted = (F.col("code") == "") & F.col("repeats").isNull() & not_logged(joined, log)
    noted = accepted & (strip("note") != "")
    applied_before = F.coalesce(F.max(accepted & (target == "applied")).over(earlier),
                                F.lit(False))
    notes = F.aggregate(
        F.collect_list(F.when(noted, strip("note"))).over(so_far), blank("_notes"),
        lambda text, note: append_note(text, note, today))
    judged = joined.withColumn("code", steps.code()) \
        .withColumn("validations", steps.validations()) \
        .withColumn("status_after", target) \
        .withColumn("new_date_applied", F.when(
            accepted & (target == "applied") & (F.col("_applied") == "") & ~applied_before,
            today.cast("string"))) \
        .withColumn("new_notes", F.when(noted, notes)) \
        .withColumn("rows_changed", F.when(F.col("code") == "", 1).otherwise(0)) \
        .select(*proposals.columns, "code", "validations", "status_before", "status_after",
                "new_date_applied", "new_notes", "rows_changed", "repeats")
    return answered(judged, ["status_before", "status_after"], ["rows_changed"], log) \
        .drop("repeats")


def status_mutations(judged: DataFrame) -> DataFrame:
    def write(field: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(field).alias("field"),
                                                  value.alias("value")))
    fields = F.array_compact(F.array(
        write("status", F.col("status_after")),
        write("date_applied", F.col("new_date_applied")),
        write("notes", F.col("new_notes"))))
    return _new(judged).select(F.col("job_id").alias("id"), "ord", F.inline(fields))


# --- log rows -----------------------------------------------------------------------------

def _new(judged: DataFrame) -> DataFrame:
    """Accepted proposals that are no repeats."""
    return judged.filter((F.col("code") == "") & ~F.col("replayed"))


def _by_job(changes: DataFrame, names: dict[str, str]) -> DataFrame:
    """(ord, job_ids, before, after) per decision from its changed rows.

    An entry lists the jobs of one company, as the log's format asks for; ``changes`` itself is
    the form for companies of any size.
    """
    pair = F.array_sort(F.collect_list(F.struct("id", "before", "after")))

    def values(side: str) -> Column:
        return F.map_from_entries(F.transform(F.col("_jobs"), lambda j: F.struct(
            j["id"].alias("key"), F.to_json(F.struct(j[side].alias(names["field"])))
            .alias("value"))))
    return changes.groupBy("ord").agg(pair.alias("_jobs")).select(
        "ord", F.to_json(F.transform("_jobs", lambda j: j["id"])).alias("_job_ids"),
        values("before").alias("before"), values("after").alias("after"))


def log_rows(judged: DataFrame, kind: str, actor_id: str = "", actor_name: str = "",
             at: str = "", changes: DataFrame | None = None) -> DataFrame:
    """Accepted decisions as log entries without seq and hashes (see audit.append).

    Repeats are in the log already. ``before`` and ``after`` hold the changed fields by job, as
    JSON; a resolution's come from ``changes`` (``resolution_changes``).
    """
    none = F.create_map().cast("map<string,string>")
    spec = {
        rules.CONFIRM: ("company", "key", ["company", "register_name", "source_rule", "supersede",
                                           "acknowledge_agency"],
                        ["company", "register_name", "rating", "rows_changed",
                         "shortlist_delta"], strip("rationale")
                        if "rationale" in judged.columns else None),
        rules.APPLICATION: ("job", "job_id", ["job_id", "applied_via", "date_applied",
                                              "notes", "override_reason"],
                            ["applied_on", "rows_changed"], None),
        rules.STATUS_SET: ("job", "job_id", ["job_id", "status", "note"],
                           ["status_before", "status_after"], None),
    }
    entity, ident, inputs, effects, reason = spec[kind]
    if kind == rules.APPLICATION:
        reason = F.when(strip("notes") != "", strip("notes")).otherwise(
            F.concat(F.lit("Applied via "), F.col("applied_via"), F.lit(".")))
    if kind == rules.STATUS_SET:
        reason = F.when(strip("note") != "", strip("note")).otherwise(F.concat(
            F.lit("Moved from "), F.col("status_before"), F.lit(" to "),
            F.col("status_after"), F.lit(".")))

    def text_map(names: list[str]) -> Column:
        return F.create_map(*[x for n in names
                              for x in (F.lit(n), blank(F.col(n).cast("string")))])
    action = F.col("action_id") if "action_id" in judged.columns else F.lit("")
    rows = _new(judged)
    if "source_rule" not in rows.columns:
        rows = rows.withColumn("source_rule", F.lit("manual"))
    before = after = none
    told = text_map(effects)
    if kind == rules.CONFIRM and changes is not None:
        rows = rows.join(_by_job(changes, {"field": "sponsor_match"}), "ord", "left")
        before, after = [F.coalesce(side, none) for side in ("before", "after")]
        told = F.map_concat(told, F.create_map(
            F.lit("job_ids"), F.coalesce("_job_ids", F.lit("[]"))))
    elif kind != rules.CONFIRM:
        told = F.map_concat(told, F.create_map(
            F.lit("job_ids"), F.to_json(F.array("job_id"))))
        one = {rules.APPLICATION: (("status", F.col("status_before"), F.lit("applied")),
                                   ("date_applied", F.lit(""), F.col("applied_on"))),
               rules.STATUS_SET: (("status", F.col("status_before"), F.col("status_after")),)}
        before, after = [F.create_map(F.col("job_id"), F.to_json(F.struct(
            *[field[side].alias(field[0]) for field in one[kind]]))) for side in (1, 2)]
    return rows.select(
        "ord", action.alias("action_id"), F.lit(at).alias("ts"),
        F.struct(F.lit(actor_id).alias("id"), F.lit(actor_name).alias("display_name"),
                 F.lit("batch").alias("via")).alias("actor"),
        F.lit(kind).alias("type"),
        F.struct(F.lit(entity).alias("kind"), F.col(ident).alias("id")).alias("entity"),
        text_map(inputs).alias("input"), "validations", reason.alias("rationale"),
        told.alias("effects"), before.alias("before"), after.alias("after"),
        F.lit(True).alias("reversible"))


def failed_writes(entries: DataFrame, reason: str = "store_locked") -> DataFrame:
    """Compensating entries for log rows whose store write did not happen."""
    return entries.select(
        "ord", F.lit("").alias("action_id"), "ts", "actor",
        F.concat("type", F.lit(rules.FAILED_SUFFIX)).alias("type"), "entity",
        F.create_map(F.lit("target_log_entry_id"), F.col("id"), F.lit("reason"),
                     F.lit(reason)).alias("input"),
        no_validations().alias("validations"),
        F.lit("Store was locked; no rows written.").alias("rationale"),
        F.create_map(F.lit("rows_changed"), F.lit("0")).alias("effects"),
        F.lit(False).alias("reversible"))


def contact_status_changes(contacts: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Contacts after status changes (id, status, note): vocabulary enforced, the first
    'contacted' stamps its date, every note of the batch is appended with the day, in order.
    ``judge_contact_changes`` has the code of each change. A contact's row lists its notes, so
    they are collected; they are joined at once, in time linear in their length."""
    ok = changes.filter(F.lower(strip("status")).isin(*rules.CONTACT_STATUSES))
    noted = F.when(strip("note") != "", F.struct("ord", "note"))
    latest = ok.groupBy("id").agg(F.max_by(F.lower(strip("status")), "ord").alias("_status"),
                                  F.array_sort(F.collect_list(noted)).alias("_notes"),
                                  F.max(F.lower(strip("status")) == "contacted")
                                  .alias("_touched"))
    today = dates.as_date(as_of)
    joined = contacts.join(latest, "id", "left")
    added = F.array_join(F.transform("_notes", lambda n: F.concat(
        today.cast("string"), F.lit(": "), strip(n["note"]))), "\n")
    before = strip("notes")
    appended = F.when(F.size("_notes") == 0, blank("notes")).when(before == "", added) \
        .otherwise(F.concat(before, F.lit("\n"), added))
    return joined.withColumns({
        "contacted_on": F.when(F.col("_touched") & (blank("contacted_on") == ""),
                               today.cast("string")).otherwise(F.col("contacted_on")),
        "notes": F.when(F.col("_notes").isNull(), F.col("notes")).otherwise(appended),
        "status": F.coalesce("_status", "status"),
    }).select(*contacts.columns)


def judge_contact_changes(contacts: DataFrame, changes: DataFrame) -> DataFrame:
    known = contacts.select("id", F.lit(True).alias("_known"))
    return changes.join(known, "id", "left").withColumn("code", F.when(
        ~F.lower(strip("status")).isin(*rules.CONTACT_STATUSES), "unknown_status")
        .when(F.col("_known").isNull(), "not_found").otherwise("")).drop("_known")
