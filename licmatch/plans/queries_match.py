"""Registered queries: joins, aggregations, windows, orders, set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from licmatch import rules
from licmatch.functions import gates
from licmatch.functions import people as pf
from licmatch.functions import text as tx
from licmatch.operators import (audit, contacts, frames, ingest, licence, people, review, search_index,
                                shortlist)
from licmatch.operators import store as st
from licmatch.operators import views
from licmatch.plans import oracle as o
from licmatch.plans import relations as r
from licmatch.plans.fixtures import AS_OF
from licmatch.plans.queries_scan import _BIO, _bios, _signal_sql
from licmatch.plans.registry import query
from licmatch.sources import feeds
from licmatch.sources.staging import staged

TODAY = AS_OF
_STAMP = ["ord", "sponsor_match", "sponsor_rating", "sponsor_route"]

# --- joins ----------------------------------------------------------------------------------


@query("j1_exact_match", f"SELECT {', '.join(_STAMP)} FROM exact_matched")
def _(t):
    return r.exact_matched(t).select(*_STAMP)


@query("j1_register_unavailable", """
    SELECT sponsor_match, count(*) AS rows FROM (
        SELECT 'unconfirmed' AS sponsor_match FROM postings) x GROUP BY 1""")
def _(t):
    return licence.match_companies(t.postings, None).groupBy("sponsor_match") \
        .agg(F.count(F.lit(1)).alias("rows"))


@query("j2_alias_match", f"SELECT {', '.join(_STAMP)} FROM matched")
def _(t):
    return r.matched(t).select(*_STAMP)


@query("j3_board_match", f"""
    SELECT p.ord, CASE WHEN a.key IS NOT NULL OR l.key IS NOT NULL THEN 'yes' ELSE 'no' END
               AS sponsor_match,
           CASE WHEN a.key IS NOT NULL THEN coalesce(ra.rating, a.rating)
                ELSE coalesce(l.rating, '') END AS sponsor_rating
    FROM (SELECT p.ord, {o.norm("coalesce(b.register_name, p.company)")} AS k
          FROM postings p LEFT JOIN boards b ON b.company = p.company AND b.register_name <> ''
               AND CASE b.ats WHEN 'greenhouse' THEN 'gh' ELSE b.ats END = p.source
          WHERE p.source <> 'adzuna') p
    LEFT JOIN al a ON a.key = p.k LEFT JOIN lk l ON l.key = p.k
    LEFT JOIN lk ra ON ra.key = {o.norm('a.register_name')}""")
def _(t):
    rows = t.postings.filter(F.col("source") != rules.AGGREGATOR_SOURCE)
    return licence.match_board_rows(rows, t.boards, r.lookup(t), t.aliases) \
        .select("ord", "sponsor_match", "sponsor_rating")


@query("j3_boards_by_slug", f"""
    SELECT f.id, CASE WHEN l.key IS NOT NULL THEN 'yes' ELSE 'no' END AS sponsor_match,
           coalesce(l.rating, '') AS sponsor_rating
    FROM (SELECT CASE p.source WHEN 'gh' THEN 'gh:' || p.ord WHEN 'ashby' THEN 'ashby:x' || p.ord
                      ELSE 'lever:y' || p.ord END AS id,
                 {o.norm("coalesce(b.name, p.company)")} AS k
          FROM postings p LEFT JOIN (
              SELECT c, ' Filler' || (c % 34) || ' x' AS name FROM emp WHERE c % 3 = 0
              UNION ALL SELECT c, name FROM emp WHERE c % 3 = 1) b ON b.c = p.ord
          WHERE p.source <> 'adzuna') f LEFT JOIN lk l ON l.key = f.k""")
def _(t):
    # Two boards may have one company and family; the slug says which one a posting is from.
    boards = t.sql("""
        SELECT 'any' AS company, f.ats, 'b' || CAST(e.c AS STRING) AS slug,
               CASE e.c % 3 WHEN 0 THEN ' Filler' || CAST(e.c % 34 AS STRING) || ' x'
                    WHEN 1 THEN e.name ELSE '' END AS register_name, CAST(e.c AS BIGINT) AS ord
        FROM emp e JOIN (SELECT 0 AS z, 'greenhouse' AS ats UNION ALL SELECT 0, 'ashby'
                         UNION ALL SELECT 0, 'lever') f ON f.z = e.c * 0""")
    rows = feeds.board_rows(t.fetches, TODAY, with_slug=True)
    return licence.match_board_rows(rows, boards, r.lookup(t)) \
        .select("id", "sponsor_match", "sponsor_rating")


@query("j4_resolution", f"""
    SELECT p.ord, x.method, x.register_name, x.rating, x.confirmed_by, x.confirmed_at
    FROM postings p JOIN resolved x ON x.key = {o.norm('p.company')}""")
def _(t):
    rows = licence.resolve(t.postings.select("ord", "company"), r.lookup(t), t.aliases,
                           t.boards)
    return rows.select("ord", *[F.col(f"resolution.{c}").alias(c) for c in (
        "method", "register_name", "rating", "confirmed_by", "confirmed_at")])


@query("j5_prefix_candidates", "SELECT key, candidate, rating, ord FROM hits WHERE rule = 0")
def _(t):
    keys = licence.open_keys(t.postings, r.lookup(t))
    return licence.candidates(keys, r.lookup(t)).filter("rule = 0") \
        .select("key", "candidate", "rating", "ord")


@query("j6_trading_candidates", "SELECT key, candidate, rating, ord FROM hits WHERE rule = 1")
def _(t):
    keys = licence.open_keys(t.postings, r.lookup(t))
    return licence.candidates(keys, r.lookup(t)).filter("rule = 1") \
        .select("key", "candidate", "rating", "ord")


@query("j7_rulings", f"""
    SELECT p.ord, u.verdict AS ruling_verdict, u.reason AS ruling_reason
    FROM postings p LEFT JOIN ruled u ON u.ck = {o.plain('p.company')}
         AND u.tk = {o.plain('p.title')}""")
def _(t):
    return shortlist.attach_rulings(t.postings, t.rulings) \
        .select("ord", "ruling_verdict", "ruling_reason")


@query("j8_insert_only_merge", """
    SELECT source, count(*) AS rows, sum(ord)::BIGINT AS ords FROM (
        SELECT source, ord FROM store
        UNION ALL SELECT source, ord FROM feed WHERE id NOT IN (SELECT id FROM store)) x
    GROUP BY source""")
def _(t):
    batch = t.feed.unionByName(t.feed.withColumn("ord", F.col("ord") + 10 ** 9))
    return st.merge(t.store, batch).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("ord").alias("ords"))


@query("j9_tracked_split", """
    SELECT id, id IN (SELECT id FROM store) AS already_tracked FROM feed""")
def _(t):
    return st.tracked_split(t.feed, t.store).select("id", "already_tracked")


@query("j10_closures", f"""
    SELECT s.id, 'absent from ' || b.ats || ' feed' AS reason FROM store s
    JOIN boards b ON b.company = s.company AND s.source <> 'adzuna'
         AND CASE b.ats WHEN 'greenhouse' THEN 'gh' ELSE b.ats END = s.source
    WHERE b.status = 'active' AND s.id NOT IN (SELECT id FROM feed) AND s.ord % 7 <> 0""")
def _(t):
    fetched = t.boards.filter("status = 'active'")
    closed = t.store.filter("ord % 7 = 0").select("id")
    return st.closures(t.store, t.feed, fetched, closed, TODAY).select("id", "reason")


@query("j11_rejection_filter", """
    SELECT h.key, h.candidate FROM top3 h WHERE NOT EXISTS (
        SELECT 1 FROM rejections x WHERE x.key = h.key AND x.register_name = h.candidate)""")
def _(t):
    keys = licence.open_keys(t.postings, r.lookup(t))
    hits = licence.suggest(keys, r.lookup(t))
    return licence.without_rejected(hits, t.rejections).select("key", "candidate")


_VIEW = """
    SELECT CASE WHEN ord % 4 = 0 THEN '' WHEN ord % 4 = 1 THEN id || '.0' ELSE id END AS id,
           title, company, CASE WHEN ord % 5 = 0 THEN 'New' WHEN ord % 5 = 1 THEN 'applied'
                                ELSE '' END AS status,
           '' AS date_applied, CASE WHEN ord % 6 = 0 THEN 'email' ELSE '' END AS applied_via,
           'n' || CAST(ord AS STRING) AS notes, ord
    FROM postings WHERE source = 'adzuna' AND ord % 2 = 0"""


@query("j12_edit_harvest", f"""
    SELECT s.id, coalesce(e.status, s.status) AS status,
           coalesce(e.applied_via, s.applied_via) AS applied_via,
           coalesce(e.notes, s.notes) AS notes
    FROM store s LEFT JOIN (
        SELECT coalesce(i.id, k.id) AS id,
               arg_max(v.status, v.ord) FILTER (v.status NOT IN ('', 'New')) AS status,
               arg_max(v.applied_via, v.ord) FILTER (v.applied_via <> '') AS applied_via,
               arg_max(v.notes, v.ord) AS notes
        FROM ({_VIEW}) v
        LEFT JOIN store i ON i.id = replace(v.id, '.0', '')
        LEFT JOIN (SELECT {o.twin('company')} AS tc, {o.twin('title')} AS tt,
                          arg_max(id, ord) AS id FROM store GROUP BY 1, 2) k
          ON k.tc = {o.twin('v.company')} AND k.tt = {o.twin('v.title')}
        GROUP BY 1) e ON e.id = s.id""")
def _(t):
    return st.harvest_edits(t.store, t.sql(_VIEW)).select("id", "status", "applied_via",
                                                          "notes")


@query("j13_register_search", """
    SELECT key AS register_name, rating FROM lk WHERE contains(key, 'RNBROO')
    ORDER BY 1 LIMIT 20""")
def _(t):
    return search_index.register_search(search_index.register_index(r.lookup(t)), "rnbroo")


@query("j13_register_prefix_search", """
    SELECT key AS register_name, rating FROM lk WHERE split_part(key, ' ', 1) = 'FILLER3'
      AND starts_with(key, 'FILLER3') ORDER BY 1 LIMIT 20""")
def _(t):
    return search_index.register_search(search_index.register_index(r.lookup(t)), "Filler3")


@query("j13_contains", """
    SELECT key, rating, 'ER ST' AS part FROM lk WHERE contains(key, 'ER ST')
    UNION ALL SELECT key, rating, 'K' FROM lk WHERE contains(key, 'K')
    UNION ALL SELECT key, rating, 'X1' FROM lk WHERE contains(key, 'X1')
    UNION ALL SELECT key, rating, 'QUARRIER' FROM lk WHERE contains(key, 'QUARRIER')""")
def _(t):
    index = search_index.build(r.lookup(t).select("key", "rating"), "key", ["key"], block=512)
    found = [search_index.containing(index, part).withColumn("part", F.lit(part))
             for part in ("ER ST", "K", "X1", "QUARRIER")]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query("j14_company_variants", f"""
    SELECT id, company FROM postings WHERE {o.norm('company')} = 'OTTOLINE1 ENGINES'""")
def _(t):
    return st.company_rows(t.postings, "The Ottoline1 Engines Ltd").select("id", "company")


@query("j15_undo_exclusion", """
    SELECT seq, id FROM dlog WHERE id NOT IN (
        SELECT target_id FROM dlog WHERE type LIKE '%.undone')""")
def _(t):
    return audit.without_undone(t.dlog).select("seq", "id")


@query("j16_replay", """
    SELECT p.seq AS ord, p.action_id, f.id AS prior_entry
    FROM dlog p LEFT JOIN (SELECT action_id, arg_max(id, seq) AS id FROM dlog
                           WHERE seq % 3 = 0 GROUP BY 1) f ON f.action_id = p.action_id
    WHERE p.seq % 2 = 0""")
def _(t):
    from licmatch.operators import decisions
    proposals = t.dlog.filter("seq % 2 = 0").select(F.col("seq").alias("ord"), "action_id")
    return decisions.replay(proposals, t.dlog.filter("seq % 3 = 0")) \
        .select("ord", "action_id", "prior_entry")


@query("j17_alias_drift", """
    SELECT company, finding FROM (
        SELECT coalesce(a.company, l.company) AS company,
               CASE WHEN l.company IS NULL THEN 'unattributed'
                    WHEN a.company IS NULL OR a.register_name <> l.register_name
                    THEN 'drift' END AS finding
        FROM aliases a FULL JOIN (SELECT * FROM live WHERE type = 'alias.confirm') l
             ON l.company = a.company) x WHERE finding IS NOT NULL""")
def _(t):
    return audit.alias_drift(t.aliases, audit.replay_aliases(t.dlog))


_VERDICTS = """
    SELECT id, CASE ord % 3 WHEN 0 THEN 'dead' WHEN 1 THEN 'live' ELSE 'unknown' END
               AS verdict FROM postings WHERE ord % 4 > 0"""


@query("j18_verdict_join", f"""
    SELECT p.id, CASE WHEN p.source = 'adzuna' THEN coalesce(v.verdict, 'unknown') END
               AS liveness
    FROM postings p LEFT JOIN ({_VERDICTS}) v ON v.id = p.id
    WHERE NOT (p.source = 'adzuna' AND coalesce(v.verdict, '') = 'dead')""")
def _(t):
    return shortlist.attach_verdicts(t.postings, t.sql(_VERDICTS)).select("id", "liveness")


_DAYS = "date_diff('day', CAST(day AS DATE), DATE '2024-02-01')"


@query("j19_cadence", f"""
    SELECT ord, {_DAYS} AS days, CAST(CASE WHEN {_DAYS} >= 14 THEN 14 WHEN {_DAYS} >= 9
           THEN 9 ELSE 4 END AS BIGINT) AS touch
    FROM touches WHERE status = 'contacted' AND {_DAYS} >= 4""")
def _(t):
    contacts = t.touches.withColumn("contacted_on", F.col("day"))
    return people.due_contacts(contacts, "2024-02-01").select("ord", "days", "touch")


@query("j20_signal_tags", f"SELECT doc_id, {_signal_sql()} AS signals FROM ({_BIO}) b")
def _(t):
    return _bios(t).select("doc_id", F.array_join(pf.matched_signals("txt"), ",")
                           .alias("signals"))


@query("j21_company_contacts", """
    SELECT ord, name FROM touches WHERE lower(trim(company)) = 'saltmarsh metrics'""")
def _(t):
    return people.contacts_of(t.touches, " Saltmarsh Metrics ").select("ord", "name")


@query("j22_flagged_suggestions", """
    SELECT h.key, h.candidate, x.key IS NOT NULL AS rejected FROM top3 h
    LEFT JOIN (SELECT DISTINCT key, register_name FROM rejections) x
      ON x.key = h.key AND x.register_name = h.candidate""")
def _(t):
    keys = licence.open_keys(t.postings, r.lookup(t))
    hits = licence.suggest(keys, r.lookup(t))
    return licence.flag_rejected(hits, t.rejections).select("key", "candidate", "rejected")


@query("j23_register_entry", f"""
    SELECT e.c, l.key IS NOT NULL AS has_entry, coalesce(l.rating, '') AS rating
    FROM emp e LEFT JOIN lk l ON l.key = {o.norm("e.name || ' uk ltd'")}""")
def _(t):
    names = t.emp.select("c", F.concat("name", F.lit(" uk ltd")).alias("asked"))
    return licence.register_entry(names, r.lookup(t), "asked") \
        .select("c", "has_entry", "rating")


@query("j24_source_groups", """
    SELECT source, count(*) AS items FROM (
        SELECT 'saved' AS source FROM touches
        UNION ALL SELECT 'person' FROM emp WHERE name IN (SELECT company FROM
                         touches)
        UNION ALL SELECT CASE WHEN n < 9 THEN 'people-search' ELSE 'web-search' END
                  FROM (SELECT DISTINCT company FROM touches) c, range(18) g(n)) x
    GROUP BY source""")
def _(t):
    found = t.emp.select(F.col("name").alias("company"),
                                           F.col("tok").alias("login"),
                                           F.lit("").alias("url"))
    groups = people.source_groups(t.touches.select("company"), found, t.touches)
    return groups.groupBy("source").agg(F.count(F.lit(1)).alias("items"))


# --- aggregations -----------------------------------------------------------------------------

@query("a1_licence_lookup", "SELECT key, rating, ord FROM lk")
def _(t):
    return r.lookup(t)


@query("a2_token_blocks", """
    SELECT 'first' AS rule, split_part(key, ' ', 1) AS token, count(*) AS entries
    FROM lk GROUP BY 2
    UNION ALL SELECT 'trade', split_part(substring(key, strpos(key, ' T A ') + 5), ' ', 1),
                     count(*) FROM lk WHERE contains(key, ' T A ') GROUP BY 2""")
def _(t):
    return licence.token_blocks(r.lookup(t))


@query("a3_company_summary", """
    SELECT c.company, c.key, c.jobs, c.tech_jobs, c.tiers, c.is_agency, x.method,
           x.register_name FROM companies c JOIN resolved x ON x.key = c.key""")
def _(t):
    rows = views.company_summary(r.matched(t), r.lookup(t), t.aliases, t.boards)
    return rows.select("company", "key", "jobs", "tech_jobs",
                       F.array_join("tiers", ",").alias("tiers"), "is_agency",
                       "resolution.method", "resolution.register_name")


@query("a4_review_candidates", """
    SELECT c.company, c.nrows AS rows, c.tiers, c.ntech AS tech_rows,
           coalesce((SELECT string_agg(t.title, '|' ORDER BY t.rn) FROM ttitles t
                     WHERE t.company = c.company), '') AS titles,
           (SELECT string_agg(h.candidate, '|' ORDER BY h.rn) FROM top3 h
            WHERE h.key = c.key) AS suggestions
    FROM cands c""")
def _(t):
    rows = review.review_candidates(r.exact_matched(t), r.lookup(t), t.aliases)
    return rows.select(
        "company", "rows", F.array_join("tiers", "/").alias("tiers"), "tech_rows",
        F.array_join("tech_titles", "|").alias("titles"),
        F.array_join(F.transform("suggestions", lambda s: s["register_name"]), "|")
        .alias("suggestions"))


_QUEUE = """
    SELECT k.key, (SELECT arg_min(c.company, (length(c.company), c.ntech = 0, -c.tcount,
                                              -c.ntech, lower(c.company), c.company))
                   FROM cands c WHERE c.key = k.key) AS company,
           (SELECT sum(c.nrows) FROM cands c WHERE c.key = k.key)::BIGINT AS rows,
           (SELECT bool_or(c.ntech > 0) FROM cands c WHERE c.key = k.key) AS priority,
           coalesce((SELECT array_to_string(list_sort(list(DISTINCT x)), '/') FROM cands c,
                     unnest(string_split(c.tiers, '/')) u(x)
                     WHERE c.key = k.key AND x <> ''), '') AS tiers,
           k.suggestions
    FROM (SELECT h.key, string_agg(h.candidate, '|' ORDER BY h.rn) AS suggestions
          FROM top3 h WHERE NOT EXISTS (SELECT 1 FROM rejections x WHERE x.key = h.key
                                        AND x.register_name = h.candidate)
            AND h.key IN (SELECT key FROM cands)
          GROUP BY h.key) k"""


@query("a5_review_queue", _QUEUE)
def _(t):
    entries = review.review_candidates(r.exact_matched(t), r.lookup(t), t.aliases,
                                       t.rejections)
    queue = review.review_queue(entries)
    return queue.select(
        "key", "company", "rows", "priority", F.array_join("tiers", "/").alias("tiers"),
        F.array_join(F.transform("suggestions", lambda s: s["register_name"]), "|")
        .alias("suggestions"))


@query("a6_facets", " UNION ALL ".join(
    f"SELECT '{f}' AS field, {f} AS value, count(*) AS jobs FROM summaries GROUP BY {f}"
    for f in views.FACETS))
def _(t):
    return views.facets(views.job_summary(r.matched(t), TODAY))


@query("a7_drop_histogram", """
    SELECT reason, count(*) AS rows FROM (
        SELECT coalesce(gate, CASE WHEN verdict = 'CUT'
                        THEN 'previously CUT (see decisions.json)' WHEN is_ag
                        THEN 'agency listing' END,
                   CASE WHEN row_number() OVER (PARTITION BY tkey, ckey,
                        gate IS NULL AND coalesce(verdict, '') <> 'CUT' AND NOT is_ag
                        ORDER BY ord) > 1 THEN 'duplicate listing' END) AS reason
        FROM gated) g WHERE reason IS NOT NULL GROUP BY 1""")
def _(t):
    return shortlist.drop_histogram(r.matched(t), t.rulings, TODAY, subjects=t.postings)


@query("a7_drops_with_delisted", """
    SELECT reason, count(*) AS rows FROM (
        SELECT id, coalesce(gate, CASE WHEN verdict = 'CUT'
                        THEN 'previously CUT (see decisions.json)' WHEN is_ag
                        THEN 'agency listing' END,
                   CASE WHEN row_number() OVER (PARTITION BY tkey, ckey,
                        gate IS NULL AND coalesce(verdict, '') <> 'CUT' AND NOT is_ag
                        ORDER BY ord) > 1 THEN 'duplicate listing' END,
                   CASE WHEN source = 'adzuna' AND ord % 3 = 0 THEN 'delisted (410 Gone)' END)
                   AS reason
        FROM gated) g WHERE reason IS NOT NULL GROUP BY 1""")
def _(t):
    verdicts = t.postings.filter("ord % 3 < 2").select("id", F.when(
        F.col("ord") % 3 == 0, "dead").otherwise("live").alias("verdict"))
    return shortlist.drop_histogram(r.matched(t), t.rulings, TODAY, subjects=t.postings,
                                    verdicts=verdicts)


@query("a7_ingest_drops", """
    SELECT CASE WHEN starts_with(drop_reason, 'not a UK') THEN 'not a UK location'
                ELSE drop_reason END AS reason, count(*) AS rows
    FROM judged WHERE drop_reason IS NOT NULL GROUP BY 1""")
def _(t):
    return ingest.drop_counts(r.judged_feed(t))


@query("a8_overview", f"""
    SELECT count(*) AS tracked,
           count(*) FILTER (NOT sent AND NOT declined AND reason IS NULL) AS ready_to_apply,
           count(*) FILTER (sent) AS applied, count(*) FILTER (sent) AS awaiting_reply,
           count(*) FILTER (NOT sent AND NOT declined AND reason IS NOT NULL)
               AS filtered_out,
           count(*) FILTER (NOT sent AND NOT declined AND reason IS NOT NULL
                            AND sponsor_match = 'no') AS filtered_no_sponsor,
           count(*) FILTER (declined) AS not_interested,
           (SELECT count(*) FROM ({_QUEUE}) q) AS needs_a_name_decision
    FROM (SELECT status = 'applied' AS sent, status = 'ignored' AS declined, sponsor_match,
                 {o.disqualified()} AS reason FROM exact_matched) m""")
def _(t):
    rows = r.exact_matched(t)
    entries = review.review_candidates(rows, r.lookup(t), t.aliases, t.rejections)
    due = entries.select(F.count_distinct("key")).scalar()
    return views.overview(rows, due)


@query("a9_dataset_meta", """
    SELECT count(*) AS rows, count(DISTINCT company) AS companies,
           (SELECT count(*) FROM aliases) AS aliases,
           (SELECT count(*) FROM lk) AS register_entries FROM postings""")
def _(t):
    return views.dataset_meta(t.postings, t.aliases, r.lookup(t))


@query("a10_run_counts", f"""
    SELECT count(*) AS new, count(*) FILTER (sponsor_match = 'yes') AS confirmed,
           count(*) FILTER (sponsor_match <> 'yes') AS others,
           (SELECT count(*) FROM feed WHERE {o.unsuitable()} IS NOT NULL
              AND id NOT IN (SELECT id FROM store)) AS filtered,
           (SELECT count(*) FROM store) + count(*) AS tracked
    FROM matched WHERE ord % 5 <> 0 AND id NOT IN (SELECT id FROM store)
      AND {o.unsuitable()} IS NULL""")
def _(t):
    batch = r.matched(t).filter("ord % 5 <> 0").filter(gates.unsuitable_reason().isNull())
    return st.run_counts(st.insert_only(t.store, batch), t.store, t.feed)


@query("a11_board_yield", """
    SELECT source, company, count(*) AS jobs, count(*) FILTER (drop_reason IS NULL) AS kept
    FROM judged GROUP BY 1, 2""")
def _(t):
    return ingest.board_yield(r.judged_feed(t))


@query("a12_shortlist_delta", f"""
    SELECT k AS key, count(*) AS delta FROM exact_matched
    WHERE sponsor_match <> 'yes' AND {o.disqualified(match="'yes'")} IS NULL GROUP BY k""")
def _(t):
    undecided = gates.status_of("sponsor_match") != "yes"
    eligible = gates.disqualify(sponsor_match=F.lit("yes")).isNull()
    return r.exact_matched(t).filter(undecided & eligible) \
        .groupBy(tx.normalize_name("company").alias("key")) \
        .agg(F.count(F.lit(1)).alias("delta"))


@query("a13_alias_projection", """
    SELECT company, register_name, rating, confirmed, actor, rationale, log_entry_id
    FROM live WHERE type = 'alias.confirm'""")
def _(t):
    return audit.replay_aliases(t.dlog).drop("ord")


def _people(t):
    return t.documents.select(
        "doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("login"),
        F.col("source").alias("org"),
        F.when(F.col("doc_id") % 3 == 0, "member").otherwise("contributor")
        .alias("relationship"), F.col("n_chars").alias("contributions"),
        F.when(F.col("doc_id") % 2 == 0, "me@x.example").otherwise("").alias("email"))


_WEIGHTS = " + ".join(f"CASE WHEN list_contains(s, '{k}') THEN {w} ELSE 0 END"
                      for k, _, w, _ in rules.SIGNALS)
_SCORED = f"""
    SELECT doc_id, CAST({_WEIGHTS} + CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END
           + CASE WHEN doc_id % 2 = 0 THEN 15 ELSE 0 END AS BIGINT) AS score
    FROM (SELECT doc_id, string_split({_signal_sql()}, ',') AS s FROM ({_BIO}) b) x"""


def _scored_people(t):
    tagged = _bios(t).withColumn("signals", pf.matched_signals("txt")).drop("txt")
    return _people(t).join(tagged, "doc_id") \
        .withColumn("routes", pf.contact_routes(F.lit(""), "email", F.lit(""))) \
        .withColumn("score", pf.person_score())


@query("a14_person_score", _SCORED)
def _(t):
    return _scored_people(t).select("doc_id", "score")


_WHO = "lower(trim(CASE WHEN handle <> '' THEN handle ELSE name END))"


@query("a15_contact_upsert", f"""
    SELECT lower(trim(company)) AS company_key, {_WHO} AS who_key, min(ord) AS first_ord,
           arg_min(name, ord) AS name,
           coalesce(arg_min(url, ord) FILTER (url <> ''), '') AS url,
           coalesce(arg_min(location, ord) FILTER (location <> ''), '') AS location,
           coalesce(arg_max(route_url, ord) FILTER (route_url <> ''), '') AS route
    FROM touches GROUP BY 1, 2""")
def _(t):
    rows = people.upsert_contacts(r.updates(t))
    return rows.select("company_key", "who_key", "first_ord", "name", "url", "location",
                       tx.blank(F.try_element_at("routes", F.lit(1))["url"]).alias("route"))


@query("a15_contacts", f"""
    SELECT substring(sha256(company_key || '|' || who_key), 1, 12) AS id, company, name, source,
           handle, url, location, 'found' AS status, day AS found_on, '' AS contacted_on, route,
           jobs, notes
    FROM (SELECT lower(trim(company)) AS company_key, {_WHO} AS who_key,
                 arg_min(trim(company), ord) AS company, arg_min(name, ord) AS name,
                 arg_min(source, ord) AS source, arg_min(handle, ord) AS handle,
                 coalesce(arg_min(url, ord) FILTER (url <> ''), '') AS url,
                 coalesce(arg_min(location, ord) FILTER (location <> ''), '') AS location,
                 coalesce(arg_max(route_url, ord) FILTER (route_url <> ''), '') AS route,
                 arg_min(day, ord) AS day,
                 coalesce(string_agg(notes, chr(10) ORDER BY ord) FILTER (notes <> ''), '') AS notes
          FROM touches GROUP BY 1, 2) c
    JOIN (SELECT company_key, who_key, string_agg(job_id, ',' ORDER BY first_ord) AS jobs FROM (
              SELECT lower(trim(company)) AS company_key, {_WHO} AS who_key, job_id,
                     min(ord) AS first_ord FROM touches GROUP BY 1, 2, 3) j GROUP BY 1, 2) l
      USING (company_key, who_key)""")
def _(t):
    saves = r.updates(t)
    # Stored contacts and two batches that are folded in the wrong order.
    stored = staged(contacts.contacts(contacts.from_saves(saves.filter("ord < 300"), TODAY)))
    late, early = (contacts.from_saves(saves.filter(cut), TODAY)
                   for cut in ("ord >= 500", "ord >= 300 AND ord < 500"))
    state = contacts.merge(contacts.merge(late, early), contacts.from_contacts(stored))
    rows = contacts.contacts(state)
    return rows.select(
        "id", "company", "name", "source", "handle", "url", "location", "status", "found_on",
        "contacted_on", tx.blank(F.try_element_at("routes", F.lit(1))["url"]).alias("route"),
        F.array_join("job_ids", ",").alias("jobs"), "notes")


@query("a15_contact_jobs", f"""
    SELECT lower(trim(company)) AS company_key, {_WHO} AS who_key, job_id,
           min(ord) AS first_ord FROM touches GROUP BY 1, 2, 3""")
def _(t):
    return people.contact_jobs(r.updates(t))


@query("a15_contact_notes", f"""
    SELECT lower(trim(company)) AS company_key, {_WHO} AS who_key, ord, notes AS note
    FROM touches WHERE notes <> ''""")
def _(t):
    return people.contact_notes(r.updates(t))


_MUTATIONS = """
    SELECT id, 'notes' AS field, 'n' || CAST(ord AS STRING) AS value, ord FROM postings
    WHERE ord % 3 = 1
    UNION ALL SELECT id, 'status', 'new', ord FROM postings WHERE ord % 2 = 0
    UNION ALL SELECT id, 'status', 'applied', ord + 1 FROM postings WHERE ord % 4 = 0"""


@query("a16_mutations", """
    SELECT id, CASE WHEN ord % 4 = 0 THEN 'applied' WHEN ord % 2 = 0 THEN 'new' ELSE status
               END AS status, CASE WHEN ord % 3 = 1 THEN 'n' || ord ELSE '' END AS notes,
           (ord % 3 = 1) OR (ord % 4 = 0 AND status <> 'applied')
           OR (ord % 4 <> 0 AND ord % 2 = 0 AND status <> 'new') AS changed FROM store""")
def _(t):
    return st.apply_mutations(t.store, t.sql(_MUTATIONS)).select("id", "status", "notes",
                                                                 "changed")


@query("a17_rescore", """
    SELECT e.id, CASE WHEN a.key IS NOT NULL AND e.sponsor_match = 'no' THEN 'yes'
                      ELSE e.sponsor_match END AS sponsor_match,
           CASE WHEN a.key IS NOT NULL AND e.sponsor_match = 'no'
                THEN m.sponsor_rating ELSE e.sponsor_rating END AS sponsor_rating,
           a.key IS NOT NULL AND e.sponsor_match = 'no' AS changed
    FROM exact_matched e JOIN matched m ON m.ord = e.ord LEFT JOIN al a ON a.key = e.k""")
def _(t):
    return st.rescore(r.exact_matched(t), r.lookup(t), t.aliases) \
        .select("id", "sponsor_match", "sponsor_rating", "changed")


# --- windows ----------------------------------------------------------------------------------

@query("w1_best_twin", "SELECT id, first_ord FROM twins WHERE rn = 1")
def _(t):
    ready = r.matched(t).filter(gates.apply_ready_reason().isNull())
    return shortlist.best_twins(ready).select("id", "first_ord")


@query("w2_first_listing", f"""
    SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {o.plain('title')},
           {o.plain('company')} ORDER BY ord) AS rn FROM postings) x WHERE rn = 1""")
def _(t):
    return shortlist.first_listings(t.postings).select("id")


@query("w3_top3_suggestions", """
    SELECT key, candidate, rating, CASE rule WHEN 0 THEN 'prefix' ELSE 'trading-as' END
               AS why, rn FROM top3""")
def _(t):
    hits = licence.suggest(licence.open_keys(t.postings, r.lookup(t)), r.lookup(t))
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy("key").orderBy("rule", "ord"))
    return hits.select("key", "candidate", "rating", "why", rank.alias("rn"))


@query("w4_first_ruling", "SELECT ck, tk, verdict, reason FROM ruled")
def _(t):
    keys = t.postings.select(tx.normalise("company").alias("company"),
                             tx.normalise("title").alias("title"), "ord") \
        .groupBy("company", "title").agg(F.min("ord").alias("ord"))
    ruled = shortlist.attach_rulings(keys, t.rulings).filter("ruling_verdict IS NOT NULL")
    return ruled.select(F.col("company").alias("ck"), F.col("title").alias("tk"),
                        F.col("ruling_verdict").alias("verdict"),
                        F.col("ruling_reason").alias("reason"))


@query("w5_latest_per_action", """
    SELECT action_id, arg_max(id, seq) AS id, max(seq) AS seq FROM dlog GROUP BY 1""")
def _(t):
    return audit.latest_per_action(t.dlog)


@query("w6_carry_forward", """
    SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
           OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked
    FROM conversations""")
def _(t):
    turns = t.conversations.withColumn("question", F.when(F.col("role") == "user",
                                                          F.col("text")))
    return frames.carry_forward(turns, ["conv_id"], "turn", "question", "asked", chunk=3) \
        .select("conv_id", "turn", "asked")


@query("w7_daily_budget", f"""
    SELECT day, ord FROM (SELECT day, ord, row_number() OVER (PARTITION BY day ORDER BY ord)
                          AS rn FROM touches) x WHERE rn <= {rules.AGGREGATOR_DAILY_CAP}""")
def _(t):
    return ingest.admitted(t.touches.select("day", "ord"), cap=rules.AGGREGATOR_DAILY_CAP)


@query("w8_blast_cap", """
    SELECT id FROM judged WHERE drop_reason IS NULL ORDER BY ord LIMIT 25""")
def _(t):
    kept = r.judged_feed(t).filter(F.col("drop_reason").isNull())
    return ingest.capped(kept, 25).select("id")


def _sealed(t):
    """The decision log as it is stored: sealed once, then read by the verification."""
    body = audit.canonical(t.dlog, ["seq", "type", "company"])
    return staged(audit.chain(t.dlog.select("seq", body.alias("body"))))


@query("w9_chain_verify", """
    SELECT FALSE AS chain_ok, min(seq) FILTER (seq % 1000 = 777) AS broken_at_seq,
           count(*) AS count FROM dlog""")
def _(t):
    sealed = _sealed(t)
    tampered = sealed.withColumn("body", F.when(F.col("seq") % 1000 == 777, "forged")
                                 .otherwise(F.col("body")))
    return audit.chain_report(audit.verify_chain(tampered, body="body"))


@query("w9_chain_intact", "SELECT TRUE AS chain_ok, NULL::BIGINT AS broken_at_seq, "
                          "count(*) AS count FROM dlog")
def _(t):
    return audit.chain_report(audit.verify_chain(_sealed(t), body="body"))


def _deleted(t, gone):
    return audit.chain_report(audit.verify_chain(_sealed(t).filter(~F.expr(gone)), body="body"))


def _deleted_sql(gone: str, first: str) -> str:
    return (f"SELECT FALSE AS chain_ok, {first} AS broken_at_seq, count(*) AS count "
            f"FROM dlog WHERE NOT ({gone})")


@query("w9_chain_deleted_chunk",
       _deleted_sql("seq BETWEEN 257 AND 512", "min(seq) FILTER (seq > 512)"))
def _(t):
    return _deleted(t, "seq BETWEEN 257 AND 512")


@query("w9_chain_deleted_tail_of_chunk",
       _deleted_sql("seq BETWEEN 200 AND 256", "min(seq) FILTER (seq > 256)"))
def _(t):
    return _deleted(t, "seq BETWEEN 200 AND 256")


@query("w9_chain_gap", _deleted_sql("seq BETWEEN 300 AND 310", "min(seq) FILTER (seq > 310)"))
def _(t):
    return _deleted(t, "seq BETWEEN 300 AND 310")


@query("w10_sequence", """
    SELECT ord, row_number() OVER (ORDER BY ord) + 7 AS seq FROM postings""")
def _(t):
    return frames.dense_sequence(t.postings.select("ord"), "ord", "seq", start=8,
                                 chunk=1000)


_FOUND = """
    SELECT company AS org, CASE WHEN ord % 17 = 0 THEN 'ci[bot]'
                           ELSE 'u' || CAST(ord % 60 AS STRING) END AS login,
           CASE WHEN ord % 3 = 0 THEN 'member' ELSE 'contributor' END AS relationship, ord
    FROM touches"""


@query("w11_members_first", f"""
    SELECT org, login, relationship FROM (
        SELECT *, row_number() OVER (PARTITION BY org ORDER BY prio, ord) AS place FROM (
            SELECT *, CASE WHEN relationship = 'member' THEN 0 ELSE 1 END AS prio,
                   row_number() OVER (PARTITION BY org, login ORDER BY CASE WHEN relationship
                       = 'member' THEN 0 ELSE 1 END, ord) AS rn
            FROM ({_FOUND}) f WHERE relationship = 'member' OR login NOT LIKE '%[bot]') g
        WHERE rn = 1) h WHERE place <= 40""")
def _(t):
    return people.first_known(t.sql(_FOUND)).select("org", "login", "relationship")


# --- orders and top-k ---------------------------------------------------------------------------

@query("q1_store_order", f"""
    SELECT id, sponsor_match, salary_max FROM matched
    ORDER BY CASE WHEN sponsor_match = 'yes' THEN 0 ELSE 1 END, {o.LONDON}, salary_max DESC,
             ord""")
def _(t):
    return shortlist.store_order(r.matched(t)).select("id", "sponsor_match", "salary_max")


@query("q2_apply_shortlist", """
    SELECT id, company, title, salary_max FROM twins WHERE rn = 1""")
def _(t):
    return shortlist.apply_shortlist(r.matched(t)).select("id", "company", "title",
                                                          "salary_max")


@query("q3_daily_shortlist", """
    SELECT id, title, company, score, reasons FROM ranked ORDER BY score DESC, ord
    LIMIT 20""")
def _(t):
    top = shortlist.daily_shortlist(r.matched(t), t.rulings, TODAY, top=20,
                                    subjects=t.postings)
    return top.select("id", "title", "company", "score",
                      F.array_join("reasons", ", ").alias("reasons"))


@query("q3_verified_shortlist", f"""
    SELECT id, score, liveness FROM (
        SELECT f.id, f.score, f.ord, CASE WHEN f.source = 'adzuna'
               THEN coalesce(v.verdict, 'unknown') END AS liveness
        FROM (SELECT z.*, {o.score()} AS score FROM (
                SELECT *, row_number() OVER (PARTITION BY tkey, ckey ORDER BY ord) AS listing
                FROM (SELECT * EXCLUDE (gate), {o.disqualified()} AS gate FROM gated) g
                WHERE gate IS NULL AND coalesce(verdict, '') <> 'CUT' AND NOT is_ag) z
              WHERE listing = 1) f
        LEFT JOIN ({_VERDICTS}) v ON v.id = f.id) y
    WHERE coalesce(liveness, '') <> 'dead' ORDER BY score DESC, ord LIMIT 20""")
def _(t):
    top = shortlist.daily_shortlist(r.matched(t), t.rulings, TODAY, top=20,
                                    verdicts=t.sql(_VERDICTS), subjects=t.postings)
    return top.select("id", "score", "liveness")


@query("q4_job_page", """
    SELECT id, score FROM summaries WHERE eligible
    ORDER BY score DESC, lower(company), ord LIMIT 50 OFFSET 100""")
def _(t):
    jobs = views.job_summary(r.matched(t), TODAY, "ord")
    return views.job_page(views.filter_jobs(jobs, eligible=True), limit=50,
                          offset=100) \
        .select("id", "score")


@query("q5_top_salary", """
    SELECT id, salary_max FROM postings ORDER BY salary_max DESC, ord LIMIT 5""")
def _(t):
    return shortlist.top_by_salary(t.postings).select("id", "salary_max")


@query("q6_review_order", """
    SELECT row_number() OVER (ORDER BY ntech = 0, tcount DESC, ntech DESC, lower(company),
                              company) AS place, company FROM cands""")
def _(t):
    entries = review.review_candidates(r.exact_matched(t), r.lookup(t), t.aliases)
    return review.numbered_queue(entries).select("place", "company")


@query("q7_people_order", f"""
    SELECT s.doc_id, s.score FROM ({_SCORED}) s JOIN documents d ON d.doc_id = s.doc_id
    ORDER BY s.score DESC, d.n_chars DESC, 'p' || s.doc_id LIMIT {rules.PEOPLE_LIMIT}""")
def _(t):
    return _scored_people(t).orderBy(*people.people_order()).limit(rules.PEOPLE_LIMIT) \
        .select("doc_id", "score")


@query("q8_follow_ups", f"""
    SELECT id, date_applied, CASE WHEN date_applied <> '' THEN
           date_diff('day', CAST(nullif(date_applied, '') AS DATE), {o.TODAY}) END AS days
    FROM postings WHERE status = 'applied' AND (date_applied = '' OR
         date_diff('day', CAST(nullif(date_applied, '') AS DATE), {o.TODAY}) >= 10)""")
def _(t):
    return views.follow_ups(t.postings, TODAY).select("id", "date_applied", "days")


@query("q9_contacts_due", f"""
    SELECT ord, days FROM (SELECT ord, {_DAYS} AS days FROM touches
                           WHERE status = 'contacted') x WHERE days >= 4
    ORDER BY days DESC, ord""")
def _(t):
    contacts = t.touches.withColumn("contacted_on", F.col("day"))
    return people.due_contacts(contacts, "2024-02-01").orderBy(F.desc("days"), "ord") \
        .select("ord", "days")


# --- set operations -----------------------------------------------------------------------------

@query("u1_source_union", """
    SELECT source, count(*) AS rows, count(DISTINCT company) AS companies FROM postings
    GROUP BY source""")
def _(t):
    boards = feeds.board_rows(t.fetches, TODAY)
    found = feeds.aggregator_rows(feeds.aggregator_jobs(t.aggregated, "body", "ord", "tier"),
                                  TODAY, "tier", keep=["ord"])
    return boards.unionByName(found).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("company").alias("companies"))


@query("u2_set_union", """
    SELECT key, array_to_string(list_sort(list(DISTINCT x)), '/') AS tiers
    FROM cands c, unnest(string_split(c.tiers, '/')) u(x) WHERE x <> '' GROUP BY key""")
def _(t):
    entries = review.review_candidates(r.exact_matched(t), r.lookup(t), t.aliases)
    return review.review_queue(entries).filter(F.size("tiers") > 0) \
        .select("key", F.array_join("tiers", "/").alias("tiers"))


@query("u3_distinct_companies", "SELECT DISTINCT company FROM postings")
def _(t):
    return views.distinct_companies(t.postings)


@query("u4_unlogged_aliases", """
    SELECT company FROM aliases EXCEPT SELECT company FROM live
    WHERE type = 'alias.confirm'""")
def _(t):
    return t.aliases.select("company") \
        .subtract(audit.replay_aliases(t.dlog).select("company"))


@query("u5_prefix_or_contains", """
    SELECT key FROM lk WHERE starts_with(key, 'FILLER1') UNION
    SELECT key FROM lk WHERE contains(key, 'UK')""")
def _(t):
    index = search_index.register_index(r.lookup(t))
    return search_index.prefix_or_contains(index, "FILLER1", "UK").select("key")


@query("u6_ordered_distinct", """
    SELECT c, concat_ws(' ', tok, CASE WHEN name <> tok THEN name END) AS spellings
    FROM emp""")
def _(t):
    return t.emp.select("c", F.array_join(F.array_distinct(F.array("tok", "name", "tok")),
                                          " ").alias("spellings"))
