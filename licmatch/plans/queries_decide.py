"""Registered queries: decision jobs and the batch twins of the streaming jobs."""
from __future__ import annotations

from pyspark.sql import functions as F

from licmatch import rules
from licmatch.functions import text as tx
from licmatch.operators import decisions, ingest
from licmatch.operators import store as st
from licmatch.plans import oracle as o
from licmatch.plans import relations as r
from licmatch.plans.fixtures import AS_OF
from licmatch.plans.registry import query
from licmatch.sources import reports
from licmatch.sources.staging import staged
from licmatch.streaming import jobs, limiter, verdicts

TODAY = AS_OF

# --- decision jobs ----------------------------------------------------------------------------

_PROPOSALS = """
    SELECT CAST(c AS BIGINT) AS ord,
           CASE WHEN c % 11 = 0 THEN 'Nobody ' || name ELSE name || ' Ltd' END AS company,
           CASE WHEN c % 7 = 0 THEN 'Unknown Entity' WHEN shape = 'suffix'
                THEN upper(name) || ' UK' WHEN shape = 'trap' THEN upper(name) ||
                ' CAPITAL PARTNERS' ELSE upper(name) END AS register_name,
           CASE WHEN c % 5 = 0 THEN 'short' ELSE 'Same registered address, checked.' END
               AS rationale,
           c % 4 = 0 AS supersede, c % 3 = 0 AS acknowledge_agency
    FROM emp WHERE shape <> 'absent' OR c % 5 = 0"""

_JUDGED = f"""
    SELECT * REPLACE (CASE WHEN code = '' AND NOT supersede AND last_value(
                               CASE WHEN code = '' THEN register_name END IGNORE NULLS) OVER earlier
                                <> register_name THEN 'already_resolved' ELSE code END AS code,
                      CASE WHEN max(code = '') OVER earlier THEN 0 ELSE undecided END AS undecided,
                      CASE WHEN max(code = '') OVER earlier THEN 0 ELSE delta END AS delta)
    FROM (SELECT p.ord, p.company, p.register_name, p.supersede, {o.norm('p.company')} AS key,
                 l.rating,
           CASE WHEN s.n IS NULL THEN 'not_found'
                WHEN l.key IS NULL THEN 'register_entry_not_found'
                WHEN a.register_name <> p.register_name AND NOT p.supersede
                THEN 'already_resolved'
                WHEN {o.agency('p.company')} AND NOT p.acknowledge_agency
                THEN 'agency_company'
                WHEN length(trim(p.rationale)) NOT BETWEEN 10 AND 500
                THEN 'rationale_required' ELSE '' END AS code,
           s.undecided, s.delta,
           1 + 1 + 1 + 1 + 1 AS checks
    FROM ({_PROPOSALS}) p
    LEFT JOIN (SELECT k, count(*) AS n, count(*) FILTER (sponsor_match <> 'yes') AS undecided,
                      count(*) FILTER (sponsor_match <> 'yes'
                          AND {o.disqualified(match="'yes'")} IS NULL) AS delta
               FROM exact_matched GROUP BY k) s ON s.k = {o.norm('p.company')}
    LEFT JOIN lk l ON l.key = {o.norm('p.register_name')}
    LEFT JOIN al a ON a.key = {o.norm('p.company')}) w
    WINDOW earlier AS (PARTITION BY key ORDER BY ord
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def _judged_resolutions(t):
    return decisions.judge_resolutions(t.sql(_PROPOSALS), r.exact_matched(t), r.lookup(t),
                                       t.aliases)


@query("d1_resolve_company", f"""
    SELECT ord, code, CASE WHEN code = '' THEN rating ELSE '' END AS rating,
           CASE WHEN code = '' THEN undecided ELSE 0 END AS rows_changed,
           CASE WHEN code = '' THEN delta ELSE 0 END AS shortlist_delta,
           CAST(CASE code WHEN '' THEN 5 WHEN 'register_entry_not_found' THEN 2
                WHEN 'already_resolved' THEN 3 WHEN 'agency_company' THEN 4 ELSE 0 END
                AS BIGINT) AS checks
    FROM ({_JUDGED}) j""")
def _(t):
    return _judged_resolutions(t).select("ord", "code", "rating", "rows_changed",
                                         "shortlist_delta",
                                         F.size("validations").alias("checks"))


@query("d1_resolution_apply", f"""
    SELECT e.id, CASE WHEN j.key IS NOT NULL AND e.sponsor_match <> 'yes' THEN 'yes'
                      ELSE e.sponsor_match END AS sponsor_match,
           CASE WHEN j.key IS NOT NULL AND e.sponsor_match <> 'yes' THEN j.rating
                ELSE e.sponsor_rating END AS sponsor_rating,
           j.key IS NOT NULL AND e.sponsor_match <> 'yes' AS changed
    FROM exact_matched e
    LEFT JOIN (SELECT key, arg_max(rating, ord) AS rating FROM ({_JUDGED}) j
               WHERE code = '' GROUP BY key) j ON j.key = e.k""")
def _(t):
    rows = r.exact_matched(t)
    mutations = decisions.resolution_mutations(_judged_resolutions(t), rows)
    return st.apply_mutations(rows, mutations).select("id", "sponsor_match",
                                                      "sponsor_rating", "changed")


# Five proposals a company: a name, the same again, another one, another one superseding, and the
# first action once more.
_REPEATED = """
    SELECT CAST(e.c * 10 + n.n AS BIGINT) AS ord, e.name AS company,
           CASE WHEN n.n IN (3, 4) THEN (SELECT min(upper(name)) FROM emp WHERE shape = 'exact')
                WHEN e.c % 7 = 0 THEN 'Unknown Entity' WHEN e.shape = 'suffix'
                THEN upper(e.name) || ' UK' ELSE upper(e.name) END AS register_name,
           CASE WHEN e.c % 5 = 0 AND n.n = 1 THEN 'short'
                ELSE 'Same registered address, checked.' END AS rationale,
           n.n = 4 AND e.c % 3 > 0 AS supersede, TRUE AS acknowledge_agency,
           'a' || CAST(e.c AS STRING) || '-' || CAST(CASE n.n WHEN 5 THEN 1 ELSE n.n END
                                                     AS STRING) AS action_id
    FROM emp e JOIN (SELECT 0 AS z, 1 AS n UNION ALL SELECT 0, 2 UNION ALL SELECT 0, 3
                     UNION ALL SELECT 0, 4 UNION ALL SELECT 0, 5) n ON n.z = e.c * 0
    WHERE e.shape <> 'trap'"""

_WALKED = f"""
    WITH RECURSIVE facts AS (
        SELECT p.*, {o.norm('p.company')} AS key, l.rating AS r, l.key IS NOT NULL AS entry,
               s.n IS NOT NULL AS tracked, s.undecided, s.delta, a.register_name AS stored,
               row_number() OVER (PARTITION BY {o.norm('p.company')} ORDER BY p.ord) AS nth
        FROM ({_REPEATED}) p
        LEFT JOIN (SELECT k, count(*) AS n, count(*) FILTER (sponsor_match <> 'yes') AS undecided,
                          count(*) FILTER (sponsor_match <> 'yes'
                              AND {o.disqualified(match="'yes'")} IS NULL) AS delta
                   FROM exact_matched GROUP BY k) s ON s.k = {o.norm('p.company')}
        LEFT JOIN lk l ON l.key = {o.norm('p.register_name')}
        LEFT JOIN al a ON a.key = {o.norm('p.company')}),
    judged AS (
        SELECT key, nth, stored AS before, FALSE AS opened, [] :: VARCHAR[] AS seen,
               CASE WHEN NOT tracked THEN 'not_found' WHEN NOT entry
                    THEN 'register_entry_not_found'
                    WHEN stored <> register_name AND NOT supersede THEN 'already_resolved'
                    WHEN length(rationale) < 10 THEN 'rationale_required' ELSE '' END AS code,
               FALSE AS replayed
        FROM facts WHERE nth = 1
        UNION ALL
        SELECT f.key, f.nth, w.now, w.opened2, w.seen2,
               CASE WHEN list_contains(w.seen2, f.action_id) THEN ''
                    WHEN NOT f.tracked THEN 'not_found' WHEN NOT f.entry
                    THEN 'register_entry_not_found'
                    WHEN w.now <> f.register_name AND NOT f.supersede THEN 'already_resolved'
                    WHEN length(f.rationale) < 10 THEN 'rationale_required' ELSE '' END,
               list_contains(w.seen2, f.action_id)
        FROM (SELECT j.key, j.nth,
                     CASE WHEN j.code = '' AND NOT j.replayed THEN g.register_name ELSE j.before
                          END AS now, j.opened OR j.code = '' AS opened2,
                     CASE WHEN j.code = '' THEN list_append(j.seen, g.action_id) ELSE j.seen END
                          AS seen2
              FROM judged j JOIN facts g ON g.key = j.key AND g.nth = j.nth) w
        JOIN facts f ON f.key = w.key AND f.nth = w.nth + 1)
    SELECT f.ord, f.key, f.action_id, j.code, j.replayed, j.before AS was, f.register_name,
           CASE WHEN j.code = '' AND NOT j.opened THEN f.undecided ELSE 0 END AS rows_changed,
           CASE WHEN j.code = '' AND NOT j.opened THEN f.delta ELSE 0 END AS delta,
           CASE WHEN j.code = '' THEN f.r ELSE '' END AS rating
    FROM judged j JOIN facts f ON f.key = j.key AND f.nth = j.nth"""


@query("d1_decision_state", f"""
    SELECT w.ord, w.code, w.replayed, w.rating, w.rows_changed,
           CASE WHEN w.replayed THEN x.delta ELSE w.delta END AS shortlist_delta,
           CASE WHEN NOT w.replayed AND w.code = '' AND w.was <> w.register_name
                THEN 'superseding ' || w.was ELSE '' END AS superseded
    FROM ({_WALKED}) w
    LEFT JOIN ({_WALKED}) x ON x.action_id = w.action_id AND x.code = '' AND NOT x.replayed""")
def _(t):
    judged = decisions.judge_resolutions(t.sql(_REPEATED), r.exact_matched(t), r.lookup(t),
                                         t.aliases)
    told = F.filter("validations", lambda v: v["rule"] == "not_already_resolved")
    return judged.select(
        "ord", "code", "replayed", "rating", "rows_changed", "shortlist_delta",
        F.when(~F.col("replayed") & (F.col("code") == "")
               & F.element_at(told, 1)["overridden"], F.element_at(told, 1)["detail"])
        .otherwise("").alias("superseded"))


@query("j16_replayed_decisions", f"""
    SELECT ord, '' AS code, 'e-' || {o.norm('company')} AS log_entry_id,
           CAST(0 AS BIGINT) AS rows_changed, 'L' AS rating
    FROM ({_REPEATED}) w WHERE ord % 10 = 4""")
def _(t):
    # The log answered these actions before; what it says is returned and nothing changes.
    asks = t.sql(_REPEATED).filter("ord % 10 = 4").drop("supersede").withColumn(
        "supersede", F.lit(False))
    log = asks.select(
        "action_id", F.concat(F.lit("e-"), tx.normalize_name("company")).alias("id"),
        F.col("ord").alias("seq"), decisions.no_validations().alias("validations"),
        F.create_map(F.lit("rating"), F.lit("L"), F.lit("rows_changed"), F.lit("9"))
        .alias("effects"))
    judged = decisions.judge_resolutions(asks, r.exact_matched(t), r.lookup(t), t.aliases, log)
    return judged.select("ord", "code", "log_entry_id", "rows_changed", "rating")


@query("d1_log_entries", f"""
    SELECT w.ord, 'company' AS kind, w.key AS ident, w.rows_changed AS jobs,
           coalesce(e.ids, '') AS job_ids, coalesce(e.before, '') AS befores
    FROM ({_WALKED}) w LEFT JOIN (
        SELECT k, string_agg('"' || id || '"', ',' ORDER BY id) AS ids,
               string_agg(id || '={{"sponsor_match":"' || sponsor_match || '"}}', ',' ORDER BY id)
                   AS before
        FROM exact_matched WHERE sponsor_match <> 'yes' GROUP BY k) e
      ON e.k = w.key AND w.rows_changed > 0
    WHERE w.code = '' AND NOT w.replayed""")
def _(t):
    rows = r.exact_matched(t)
    # Written once: the entries and the changes they tell of both read it.
    judged = staged(decisions.judge_resolutions(t.sql(_REPEATED), rows, r.lookup(t), t.aliases))
    entries = decisions.log_rows(judged, rules.CONFIRM, at="2001-08-15",
                                 changes=decisions.resolution_changes(judged, rows))
    pairs = F.array_sort(F.transform(F.map_entries("before"), lambda e: F.concat_ws(
        "=", e["key"], e["value"])))
    return entries.select(
        "ord", "entity.kind", F.col("entity.id").alias("ident"),
        F.element_at("effects", F.lit("rows_changed")).cast("bigint").alias("jobs"),
        F.regexp_replace(F.element_at("effects", F.lit("job_ids")), r"[\[\]]", "")
        .alias("job_ids"), F.array_join(pairs, ",").alias("befores"))


_APPLICATIONS = f"""
    SELECT ord, CASE WHEN ord % 13 = 0 THEN 'zz' || id ELSE id END AS job_id,
           CASE WHEN ord % 6 = 0 THEN 'pigeon' ELSE 'company site' END AS applied_via,
           CASE ord % 8 WHEN 0 THEN '' WHEN 1 THEN '2001-09-30' WHEN 2 THEN 'soon'
                ELSE '2001-08-01' END AS date_applied,
           CASE WHEN ord % 2 = 0 THEN 'sent' ELSE '' END AS notes,
           CASE WHEN ord % 3 = 0 THEN 'they asked me' ELSE '' END AS override_reason
    FROM postings"""


@query("d2_log_application", f"""
    SELECT p.ord, CASE WHEN p.ord % 13 = 0 THEN 'not_found'
                WHEN m.status <> 'new' THEN 'already_actioned'
                WHEN p.ord % 6 = 0 THEN 'unknown_method'
                WHEN p.ord % 8 IN (1, 2) THEN 'ineligible'
                WHEN m.reason IS NOT NULL AND p.ord % 3 <> 0 THEN 'ineligible'
                ELSE '' END AS code
    FROM postings p JOIN (SELECT ord, status, {o.disqualified()} AS reason FROM matched) m
      ON m.ord = p.ord""")
def _(t):
    return decisions.judge_applications(t.sql(_APPLICATIONS), r.matched(t), TODAY) \
        .select("ord", "code")


@query("d2_application_apply", f"""
    SELECT m.id, CASE WHEN ok THEN 'applied' ELSE m.status END AS status,
           CASE WHEN ok AND m.ord % 8 = 0 THEN '{AS_OF}' WHEN ok THEN '2001-08-01'
                ELSE m.date_applied END AS date_applied,
           CASE WHEN ok AND m.ord % 2 = 0 THEN 'sent' ELSE m.notes END AS notes
    FROM (SELECT *, ord % 13 <> 0 AND status = 'new' AND ord % 6 <> 0
                 AND ord % 8 NOT IN (1, 2)
                 AND ({o.disqualified()} IS NULL OR ord % 3 = 0) AS ok FROM matched) m""")
def _(t):
    rows = r.matched(t)
    judged = decisions.judge_applications(t.sql(_APPLICATIONS), rows, TODAY)
    return st.apply_mutations(rows, decisions.application_mutations(judged)) \
        .select("id", "status", "date_applied", "notes")


_MOVES = """
    SELECT ord, CASE WHEN ord % 17 = 0 THEN 'zz' ELSE id END AS job_id,
           CASE ord % 5 WHEN 0 THEN ' Applied ' WHEN 1 THEN 'screening' WHEN 2 THEN 'new'
                WHEN 3 THEN 'hired' ELSE 'closed' END AS status,
           CASE WHEN ord % 2 = 0 THEN 'called back' ELSE '' END AS note FROM postings"""


@query("d3_set_status", f"""
    SELECT ord, CASE WHEN ord % 17 = 0 THEN 'not_found' WHEN ord % 5 = 3
                THEN 'unknown_status'
                WHEN status = CASE ord % 5 WHEN 0 THEN 'applied' WHEN 1 THEN 'screening'
                                           WHEN 2 THEN 'new' ELSE 'closed' END
                THEN 'already_actioned' ELSE '' END AS code,
           CASE WHEN ord % 17 <> 0 AND ord % 5 = 0 AND status <> 'applied'
                THEN CASE WHEN date_applied = '' THEN '{AS_OF}' END END AS new_date_applied,
           CASE WHEN ord % 17 <> 0 AND ord % 5 <> 3 AND ord % 2 = 0 AND status <>
                CASE ord % 5 WHEN 0 THEN 'applied' WHEN 1 THEN 'screening'
                             WHEN 2 THEN 'new' ELSE 'closed' END
                THEN '{AS_OF}: called back' END AS new_notes
    FROM postings""")
def _(t):
    return decisions.judge_status_changes(t.sql(_MOVES), t.postings, TODAY) \
        .select("ord", "code", "new_date_applied", "new_notes")


@query("d4_confirm_ticks", f"""
    SELECT t.company, t.register_name, coalesce(l.rating, '') AS rating
    FROM (SELECT name AS company, CASE WHEN arg_max(c % 3, c) = 0 THEN upper(name) || ' UK'
                 ELSE upper(name) || ' GROUP' END AS register_name
          FROM emp WHERE c % 3 = 0 OR c % 2 = 0 GROUP BY name
          UNION ALL SELECT 'Fixed ' || (c % 40), 'FIXED ' || max(c) FROM emp
                    WHERE c % 5 = 0 GROUP BY c % 40) t
    LEFT JOIN lk l ON l.key = t.register_name""")
def _(t):
    from licmatch.operators import review
    ticks = reports.read_ticks(reports.split_blocks(t.ticked, "body", "ord"), ["ord", "pos"])
    return review.confirmations(ticks, r.lookup(t), TODAY).drop("confirmed")


@query("d4_overlay_after_ticks", """
    SELECT coalesce(t.company, a.company) AS company,
           coalesce(t.register_name, a.register_name) AS register_name,
           CASE WHEN t.company IS NULL THEN a.rating ELSE coalesce(l.rating, '') END AS rating,
           CASE WHEN t.company IS NULL THEN a.actor ELSE '' END AS actor
    FROM (SELECT name AS company, CASE WHEN arg_max(c % 3, c) = 0 THEN upper(name) || ' UK'
                 ELSE upper(name) || ' GROUP' END AS register_name
          FROM emp WHERE c % 3 = 0 OR c % 2 = 0 GROUP BY name
          UNION ALL SELECT 'Fixed ' || (c % 40), 'FIXED ' || max(c) FROM emp
                    WHERE c % 5 = 0 GROUP BY c % 40) t
    FULL JOIN aliases a ON a.company = t.company LEFT JOIN lk l ON l.key = t.register_name""")
def _(t):
    from licmatch.operators import review
    ticks = reports.read_ticks(reports.split_blocks(t.ticked, "body", "ord"), ["ord", "pos"])
    after = review.with_confirmations(t.aliases, review.confirmations(ticks, r.lookup(t), TODAY))
    return after.select("company", "register_name", "rating", tx.blank("actor").alias("actor"))


@query("d5_failed_writes", """
    SELECT seq AS ord, type || '.failed' AS type, id AS target_id FROM dlog
    WHERE type = 'alias.confirm'""")
def _(t):
    entries = r.log(t).filter(F.col("type") == rules.CONFIRM).withColumns({
        "ord": F.col("seq"), "actor": F.struct(F.lit("a").alias("id"))})
    failed = decisions.failed_writes(entries)
    return failed.select("ord", "type", F.col("input")["target_log_entry_id"]
                         .alias("target_id"))


@query("d6_contact_status", """
    SELECT c.id, coalesce(u.status, c.status) AS status,
           CASE WHEN u.touched THEN '2024-02-01' ELSE '' END AS contacted_on,
           coalesce(u.notes, '') AS notes
    FROM (SELECT DISTINCT 'h' || (ord % 500) AS id, 'found' AS status FROM touches) c
    LEFT JOIN (SELECT 'h' || (ord % 700) AS id, arg_max(status, ord) AS status,
                      string_agg('2024-02-01: ' || notes, chr(10) ORDER BY ord)
                          FILTER (notes <> '') AS notes,
                      bool_or(status = 'contacted') AS touched
               FROM touches WHERE ord % 3 = 0 GROUP BY 1) u ON u.id = c.id""")
def _(t):
    contacts = t.sql("SELECT DISTINCT 'h' || CAST(ord % 500 AS STRING) AS id, 'found' AS "
                     "status, '' AS contacted_on, '' AS notes FROM touches")
    changes = t.sql("SELECT 'h' || CAST(ord % 700 AS STRING) AS id, status, notes AS note, "
                    "ord FROM touches WHERE ord % 3 = 0")
    return decisions.contact_status_changes(contacts, changes, "2024-02-01")


# --- batch twins of the streaming jobs --------------------------------------------------------

@query("st1_feed_ingest", f"""
    SELECT j.id, j.company, CASE WHEN a.key IS NOT NULL OR l.key IS NOT NULL THEN 'yes'
                                 ELSE 'no' END AS sponsor_match
    FROM (SELECT j.*, {o.norm("coalesce(b.register_name, j.company)")} AS k
          FROM judged j LEFT JOIN boards b ON b.company = j.company AND b.register_name <> ''
               AND CASE b.ats WHEN 'greenhouse' THEN 'gh' ELSE b.ats END = j.source
          WHERE j.drop_reason IS NULL) j
    LEFT JOIN al a ON a.key = j.k LEFT JOIN lk l ON l.key = j.k""")
def _(t):
    feed = t.feed.filter(F.col("source") != rules.AGGREGATOR_SOURCE)
    run = ingest.ingest(feed, t.store, t.boards, r.lookup(t), t.aliases, t.boards, None,
                        TODAY)
    return run.new_rows.select("id", "company", "sponsor_match")


@query("st4_verdict_cache", """
    SELECT id, CASE WHEN dead THEN 'dead' WHEN live_at IS NOT NULL
                     AND date_diff('second', live_at, TIMESTAMP '2024-02-01') < 259200
                    THEN 'live' ELSE 'unknown' END AS verdict
    FROM (SELECT 'j' || (user_id * 7 + event_id % 9) AS id,
                 bool_or(event_type = 'error') AS dead,
                 max(ts) FILTER (event_type IN ('view', 'click')) AS live_at
          FROM events GROUP BY 1) v""")
def _(t):
    probes = t.events.select(
        F.concat(F.lit("j"), (F.col("user_id") * 7 + F.col("event_id") % 9)
                 .cast("string")).alias("id"),
        F.expr("CASE event_type WHEN 'error' THEN 'dead' WHEN 'view' THEN 'live' "
               "WHEN 'click' THEN 'live' ELSE 'unknown' END").alias("verdict"),
        F.col("ts").cast("timestamp").alias("checked"))
    return verdicts.current(verdicts.fold(probes), "2024-02-01 00:00:00") \
        .select("id", "verdict")


@query("st5_idempotent_actions", """
    SELECT action_id, min(seq) AS seq FROM dlog GROUP BY 1""")
def _(t):
    from licmatch.operators.frames import first_per_key
    return first_per_key(t.dlog.select("action_id", "seq"), ["action_id"], ["seq"])


@query("st6_rate_limiter", """
    WITH RECURSIVE h AS (
        SELECT event_type AS key, floor(epoch(ts) / 60) * 60 AS at_s, min(event_id) AS ord
        FROM events GROUP BY ALL),
    a(key, at_s) AS (
        SELECT key, min(at_s) FROM h GROUP BY key
        UNION ALL
        SELECT a.key, (SELECT min(h.at_s) FROM h WHERE h.key = a.key
                       AND h.at_s > a.at_s + 600) FROM a WHERE a.at_s IS NOT NULL)
    SELECT h.key, h.ord FROM a JOIN h ON h.key = a.key AND h.at_s = a.at_s""")
def _(t):
    hits = t.events.select(F.col("event_type").alias("key"),
                           F.date_trunc("minute", F.col("ts").cast("timestamp"))
                           .cast("double").alias("at"),
                           F.col("event_id").alias("ord"))
    return limiter.admitted(hits, limit=1, window=600.0).select("key", "ord")


@query("st8_board_health", """
    SELECT ats, company AS slug, arg_max(CASE WHEN http_status = 404 THEN 'not_found'
                                         ELSE 'active' END, ord) AS outcome
    FROM fetches WHERE http_status <> 503 GROUP BY 1, 2""")
def _(t):
    return jobs.board_health(t.fetches.withColumn("slug", F.col("company")))


@query("st_daily_decisions", """
    SELECT day, type, count(*) AS decisions FROM dlog GROUP BY 1, 2""")
def _(t):
    counted = jobs.daily_decisions(t.dlog.withColumn("at", F.to_timestamp("day")), "at")
    return counted.select(F.col("window.start").cast("date").cast("string").alias("day"), "type",
                          "decisions")
