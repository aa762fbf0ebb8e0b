"""Registered queries: sources, sinks, projections, filters."""
from __future__ import annotations

from pyspark.sql import functions as F

from licmatch import rules, schema
from licmatch.functions import dates, gates
from licmatch.functions import people as pf
from licmatch.functions import text as tx
from licmatch.operators import audit, decisions, shortlist, store, views
from licmatch.operators.frames import number_by_range
from licmatch.plans import oracle as o
from licmatch.plans import relations as r
from licmatch.plans.fixtures import AS_OF
from licmatch.plans.registry import query, split_bytes
from licmatch.sources import feeds, reports, searches, tables
from licmatch.sources.staging import staged, staging

TODAY = AS_OF

# --- derived tables ------------------------------------------------------------------------

for _name in ("emp", "register", "postings"):
    query(f"fx_{_name}", f"SELECT * FROM {_name}")(lambda t, n=_name: getattr(t, n))

# --- sources and sinks -----------------------------------------------------------------------

_CSV_LINE = ("'\"' || org || '\",' || town_city || ',' || county || ',\"' || type_rating "
             "|| '\",' || route")


@query("s1_register_scan", "SELECT ord, org, town_city, type_rating, route FROM register")
def _(t):
    lines = t.sql(f"SELECT ord, {_CSV_LINE} AS line FROM register")
    return tables.parse_register_lines(lines).select("ord", "org", "town_city",
                                                     "type_rating", "route")


_RAW_BOARDS = """
    SELECT CASE WHEN ord % 29 = 0 THEN ' #' ELSE ' ' END || company AS company, ats,
           CASE WHEN ord % 31 = 0 THEN ' ' ELSE slug || ' ' END AS slug, register_name,
           status, last_ok, notes, ord FROM boards"""


@query("s2_board_registry", """
    SELECT company, ats, slug, register_name, status, ord FROM boards
    WHERE ord % 29 <> 0 AND ord % 31 <> 0""")
def _(t):
    return tables.clean_boards(t.sql(_RAW_BOARDS), "ord").drop("last_ok", "notes")


@query("s3_board_file", """
    SELECT company, ats, slug, register_name, status, last_ok, notes FROM boards""")
def _(t):
    return tables.board_file_order(t.boards)


_OUTCOMES = f"""
    SELECT ats, slug, CASE c5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'transient'
                              WHEN 2 THEN 'empty' ELSE 'active' END AS outcome,
           CASE WHEN c5 = 2 THEN '' ELSE 'seen' END AS note
    FROM (SELECT ats, slug, ord, ord % 5 AS c5 FROM boards) b WHERE ord % 7 <> 3"""


@query("s4_board_outcomes", f"""
    SELECT b.ats, b.slug,
           CASE WHEN o.outcome IS NULL OR o.outcome = 'transient' THEN b.status
                ELSE o.outcome END AS status,
           CASE WHEN o.outcome IN ('active', 'empty') THEN '{AS_OF}' ELSE '' END AS last_ok,
           CASE WHEN o.outcome IN ('active', 'not_found') THEN o.note ELSE '' END AS notes
    FROM boards b LEFT JOIN ({_OUTCOMES}) o ON o.ats = b.ats AND o.slug = b.slug""")
def _(t):
    merged = tables.merge_outcomes(t.boards, t.sql(_OUTCOMES), TODAY)
    return merged.select("ats", "slug", "status", "last_ok", "notes")


@query("s5_greenhouse_scan", """
    SELECT ord, CAST(0 AS BIGINT) AS pos, CAST(ord AS VARCHAR) AS job_id, ' ' || title AS title,
           location || ' ' AS place, CAST(2 AS BIGINT) AS departments FROM postings WHERE source = 'gh'""")
def _(t):
    jobs = feeds.greenhouse_jobs(t.fetches.filter("ats = 'greenhouse'"), "body", "ord")
    return jobs.select("ord", "pos", F.col("job.id").alias("job_id"), "job.title",
                       F.col("job.location.name").alias("place"),
                       F.size("job.departments").alias("departments"))


@query("s6_ashby_scan", """
    SELECT ord, 'x' || ord AS job_id, title, CAST(CASE ord % 3 WHEN 0 THEN 1 WHEN 1 THEN 2
           ELSE 0 END AS BIGINT) AS extra_locations FROM postings WHERE source = 'ashby'""")
def _(t):
    jobs = feeds.ashby_jobs(t.fetches.filter("ats = 'ashby'"), "body", "ord")
    return jobs.select("ord", F.col("job.id").alias("job_id"), "job.title",
                       F.size("job.secondaryLocations").alias("extra_locations"))


@query("s7_lever_scan", """
    SELECT ord, 'y' || ord AS job_id, title,
           CAST((11549 - ord % 121) * 86400000 + 3600000 AS VARCHAR) AS created
    FROM postings WHERE source = 'lever'""")
def _(t):
    jobs = feeds.lever_jobs(t.fetches.filter("ats = 'lever'"), "body", "ord")
    return jobs.select("ord", F.col("job.id").alias("job_id"), F.col("job.text")
                       .alias("title"), F.col("job.createdAt").alias("created"))


@query("s8_aggregator_scan", """
    SELECT ord, CAST(9990000000 + ord AS VARCHAR) AS job_id, company, salary_max
    FROM postings WHERE source = 'adzuna'""")
def _(t):
    jobs = feeds.aggregator_jobs(t.aggregated, "body", "ord")
    return jobs.select("ord", F.col("job.id").alias("job_id"),
                       F.col("job.company.display_name").alias("company"),
                       F.col("job.salary_max").alias("salary_max"))


@query("s9_fetch_outcome", """
    SELECT ord, CASE WHEN ord % 19 = 0 THEN 'not_found' WHEN ord % 19 = 1 THEN 'transient'
                     WHEN ord % 19 = 2 THEN CASE WHEN source = 'gh' THEN 'empty'
                                                 ELSE 'not_found' END
                     WHEN ord % 19 = 3 THEN CASE WHEN source = 'lever' THEN 'not_found'
                                                 ELSE 'empty' END
                     WHEN ord % 19 = 4 THEN 'transient' ELSE 'active' END AS outcome
    FROM postings WHERE source <> 'adzuna'""")
def _(t):
    odd = F.col("ord") % 19
    body = F.when(odd == 2, '{"error":"no such board"}') \
        .when(odd == 3, '{"jobs":[]}').when(odd == 4, "{broken").otherwise(F.col("body"))
    return feeds.fetch_outcomes(t.fetches.withColumn("body", body)).select("ord", "outcome")


_DIRTY_STORE = """
    SELECT CASE WHEN source = 'adzuna' AND ord % 4 = 1 THEN id || '.0'
                WHEN ord % 41 = 0 THEN '' ELSE id END AS id, title, company,
           CASE WHEN ord % 2 = 0 THEN source ELSE '' END AS source,
           CAST(ord * 2 AS BIGINT) AS ord FROM postings
    UNION ALL SELECT id, title || ' II', company, source, CAST(ord * 2 + 1 AS BIGINT)
              FROM postings WHERE ord % 6 = 0"""


@query("s10_store_load", """
    SELECT id, CASE WHEN ord % 6 = 0 THEN title || ' II' ELSE title END AS title, source
    FROM postings WHERE ord % 41 <> 0 OR ord % 6 = 0
       OR (source = 'adzuna' AND ord % 4 = 1)""")
def _(t):
    return store.load_rules(t.sql(_DIRTY_STORE)).select("id", "title", "source")


@query("s11_legacy_store", """
    SELECT company AS id, arg_max(title, ord) AS title FROM postings GROUP BY company""")
def _(t):
    # Files of the kind the old store was: quoted texts, some with line breaks.
    old = t.postings.select(F.col("company").alias("id"), "title", "ord", F.expr(
        "concat('first \"line\"', repeat(',\n', cast(ord % 3 as int)), 'last')").alias("notes"))
    with staging(t.spark) as folder:
        old.orderBy("ord").drop("ord").write.option("header", True) \
            .option("escape", '"').option("quoteAll", True).csv(f"{folder}/old")
        loaded = tables.read_csv_store(t.spark, f"{folder}/old")
        return staged(loaded.select("id", "title"))


@query("s1_register_file", """
    SELECT count(*) AS rows, count(DISTINCT org) AS names,
           count(*) FILTER (contains(town_city, chr(10))) AS broken,
           CAST(sum(length(town_city)) AS BIGINT) AS letters,
           CAST(sum(place * length(town_city)) AS BIGINT) AS ordered
    FROM (SELECT org, town_city || CASE WHEN ord % 7 = 0 THEN chr(10) || '"' || chr(10) || 'x'
                                        ELSE '' END AS town_city,
                 row_number() OVER (ORDER BY ord) AS place FROM register) q""")
def _(t):
    town = F.when(F.col("ord") % 7 == 0, F.concat("town_city", F.lit('\n"\nx'))) \
        .otherwise(F.col("town_city"))
    names = schema.REGISTER_CSV.fieldNames()
    rows = t.register.withColumn("town_city", town).orderBy("ord") \
        .select("org", "town_city", "county", "type_rating", "route").toDF(*names)
    with staging(t.spark) as folder, split_bytes(t.spark, 65536):
        rows.write.option("header", True).option("escape", '"').csv(f"{folder}/register")
        read = staged(tables.read_register(t.spark, f"{folder}/register"), f"{folder}/rows")
        return staged(read.agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("org").alias("names"),
            F.count_if(F.contains("town_city", F.lit("\n"))).alias("broken"),
            F.sum(F.length("town_city")).alias("letters"),
            F.sum((F.col("ord") + 1) * F.length("town_city")).alias("ordered")))


@query("s12_snapshot_rows", f"""
    SELECT row_number() OVER (ORDER BY CASE WHEN sponsor_match = 'yes' THEN 0 ELSE 1 END,
                              {o.LONDON}, -salary_max, ord) AS place, id
    FROM matched""")
def _(t):
    return tables.numbered_snapshot(r.matched(t)).select("place", "id")


@query("s13_shortlist_view", """
    SELECT id, title, company, location, tier, salary_max, sponsor_rating, status,
           date_applied, applied_via, notes, redirect_url FROM twins WHERE rn = 1""")
def _(t):
    return tables.shortlist_view(r.matched(t))


@query("s14_rejections", f"""
    SELECT {o.norm('name')} AS key, 'C ' || arg_max(c, c) AS register_name FROM emp
    GROUP BY 1""")
def _(t):
    # Both spellings of an employer become one key; the later entry counts.
    entry = F.concat(F.lit('"'), "name", F.lit('":["A '), "c", F.lit('","B"],"'), F.upper("name"),
                     F.lit(' Ltd":["C '), "c", F.lit('"]'))
    files = t.emp.groupBy((F.xxhash64(tx.normalize_name("name")) % 16).alias("file")).agg(F.concat(
        F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "c", entry.alias("text")))), lambda e: e["text"]), ","), F.lit("}")).alias("value"))
    return tables.explode_rejections(files)


_OVERLAY = """
    SELECT c, CASE WHEN c % 9 = 0 THEN '{broken' ELSE '{"' || name || '":{"register_name":"'
           || upper(name) || ' UK","rating":"A"},"' || name || ' 2":{"register_name":"X"}}'
           END AS body FROM emp"""


@query("s14_overlay_read", """
    SELECT c, name AS company, upper(name) || ' UK' AS register_name, 'A' AS rating,
           CAST(0 AS BIGINT) AS ord
    FROM emp WHERE c % 9 <> 0
    UNION ALL SELECT c, name || ' 2', 'X', '', 1 FROM emp WHERE c % 9 <> 0""")
def _(t):
    rows = tables.explode_map(t.sql(_OVERLAY), "body", schema.ALIAS_MAP, "company")
    return rows.select("c", "company", "register_name", tx.blank("rating").alias("rating"),
                       "ord")


@query("s15_overlay_rows", """
    SELECT company, register_name, rating, confirmed, actor FROM aliases""")
def _(t):
    return t.aliases.select("company", "register_name", "rating", "confirmed", "actor") \
        .orderBy("company")


_LOG_LINES = """
    SELECT CASE WHEN seq % 13 = 0 THEN '  ' WHEN seq % 17 = 0 THEN '{"seq": 1, "id'
           ELSE '{"seq":' || CAST(seq AS STRING) || ',"id":"' || id || '","type":"' || type
                || '","ts":"' || day || 'T00:00:00Z","input":{"company":"' || company
                || '"},"entity":{"kind":"company","id":"K"},"effects":{"rating":"' || rating
                || '"}}' END AS value FROM dlog"""


@query("s16_log_scan", """
    SELECT seq, id, type, day, company, rating FROM dlog
    WHERE seq % 13 <> 0 AND seq % 17 <> 0""")
def _(t):
    entries = tables.parse_log_lines(t.sql(_LOG_LINES))
    return entries.select("seq", "id", "type", F.substring("ts", 1, 10).alias("day"),
                          F.col("input")["company"].alias("company"),
                          F.col("effects")["rating"].alias("rating"))


@query("s17_log_append", """
    SELECT count(*) AS entries, max(n) AS last_seq,
           list_reduce(list_prepend('sha256:' || sha256('last'), list(body ORDER BY n)),
                       lambda h, x: 'sha256:' || sha256(h || chr(10) || x)) AS last_hash
    FROM (SELECT n, '{"action_id":"' || action_id || '","id":"'
                 || substring(sha256(n || '|' || action_id || '|' || day), 1, 16)
                 || '","seq":' || n || ',"ts":"' || day || '","type":"' || type || '"}' AS body
          FROM (SELECT (SELECT max(seq) FROM dlog) + seq AS n, action_id, day, type
                FROM dlog) b) e""")
def _(t):
    end = t.dlog.agg(F.max("seq").alias("seq"))
    base = end.select("seq", F.lit("").alias("prev_hash"),
                      audit.digest(F.lit("last")).alias("hash"), F.lit("").alias("body"))
    batch = t.dlog.select(F.col("seq").alias("ord"), "action_id", F.col("day").alias("ts"),
                          "type")
    return audit.append(base, batch, ["action_id", "ts", "type"], chunk=None).agg(
        F.count(F.lit(1)).alias("entries"), F.max("seq").alias("last_seq"),
        F.max_by("hash", "seq").alias("last_hash"))


_REPORT = f"""
    SELECT rank, '## ' || rank || '. ' || title || ' — ' || company
           || CASE WHEN source = 'adzuna' THEN '' ELSE ' **[direct employer board]**' END
           || chr(10) || '- Score: ' || score || ' (' || reasons || ')'
           || chr(10) || '- Location: ' || location || ' | Tier: ' || tier
           || ' | Sponsor: ' || sponsor_rating || ' | Posted: ' || {o.age('posted_date')}
           || 'd ago'
           || CASE WHEN {o.HINT} <> '' THEN chr(10) || '- ⚠️ The posting mentions clearance '
              || 'eligibility. Read it before applying: SC normally needs five years'' UK '
              || 'residency and DV considerably more.' ELSE '' END
           || CASE WHEN verdict IS NOT NULL THEN chr(10) || '- **Prior research (' || verified
              || '):** ' || ruling_reason ELSE '' END
           || chr(10) || '- URL: ' || redirect_url || chr(10) || '- Tracker id: `' || id
           || '`' || chr(10) || '- [ ] triaged   - [ ] packed   - [ ] submitted' AS block
    FROM (SELECT k.*, r2.verified, row_number() OVER (ORDER BY score DESC, ord) AS rank
          FROM ranked k LEFT JOIN ruled r2 ON r2.ck = k.ckey AND r2.tk = k.tkey) z
    WHERE rank <= 30"""


@query("s18_shortlist_report", _REPORT)
def _(t):
    top = shortlist.daily_shortlist(r.matched(t), t.rulings, TODAY, top=30,
                                    subjects=t.postings)
    return reports.shortlist_report(top, TODAY)


@query("s19_review_report", """
    SELECT CASE WHEN c.ntech > 0 THEN 'worth deciding' ELSE 'probably not worth it' END
               AS section, c.company,
           '### ' || c.company || chr(10) || '*' || c.nrows || ' role(s) tracked'
           || CASE WHEN c.tcount > 0 THEN ', tier ' || c.tiers ELSE '' END || '*'
           || coalesce((SELECT string_agg(chr(10) || '  - ' || t.title, '' ORDER BY t.rn)
                        FROM ttitles t WHERE t.company = c.company), '')
           || (SELECT string_agg(chr(10) || '- [ ] `' || h.candidate || '` ('
                      || CASE WHEN h.rating = '' THEN 'no rating' ELSE h.rating END || ', '
                      || CASE h.rule WHEN 0 THEN 'prefix' ELSE 'trading-as' END || ')', ''
                      ORDER BY h.rn)
               FROM top3 h WHERE h.key = c.key) AS block
    FROM cands c""")
def _(t):
    from licmatch.operators import review
    entries = review.review_candidates(r.exact_matched(t), r.lookup(t), t.aliases)
    return reports.review_blocks(entries).select("section", "company", "block")


_TICKS = """
    SELECT company, arg_max(register_name, place) AS register_name FROM (
        SELECT name AS company, CASE WHEN c % 3 = 0 THEN upper(name) || ' UK'
                                     ELSE upper(name) || ' GROUP' END AS register_name,
               c * 10 AS place FROM emp WHERE c % 3 = 0 OR c % 2 = 0
        UNION ALL
        SELECT 'Fixed ' || (c % 40), 'FIXED ' || c, c * 10 + 1 FROM emp WHERE c % 5 = 0) x
    GROUP BY company"""


@query("s20_review_ticks", _TICKS)
def _(t):
    return reports.read_ticks(reports.split_blocks(t.ticked, "body", "ord"), ["ord", "pos"])


_SEARCH_VALUES = ", ".join(
    f"('{tier}', {o.q(word)}, '{cat or ''}')"
    for tier, words, cats in rules.SEARCH_TIERS for word in words for cat in cats)


@query("s21_search_plan", f"""
    SELECT v.tier, v.keywords, v.category, count(p.id) AS postings
    FROM (VALUES {_SEARCH_VALUES}) v(tier, keywords, category)
    LEFT JOIN (SELECT id, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))
                      || ' ' AS words FROM postings) p
      ON contains(p.words, ' ' || regexp_replace(lower(v.keywords), '[^a-z0-9]+', ' ', 'g')
                           || ' ')
    GROUP BY 1, 2, 3""")
def _(t):
    return searches.search_hits(searches.search_plan(t.spark), t.postings)


_LINE = ("'  ' || rpad(CASE WHEN sponsor_match = 'yes' THEN '[SPONSOR ' || "
         "CASE WHEN sponsor_rating = '' THEN '?' ELSE sponsor_rating END || ']' ELSE '' END, "
         "13, ' ') || ' T' || tier || ' ' || rpad('£' || format('{:,}', "
         "CAST(salary_max AS BIGINT)), 12, ' ') || ' ' || title || ' @ ' || company || ' (' "
         "|| location || ')'")


@query("s22_run_summary", f"""
    SELECT 'shortlist' AS section, ord, {_LINE} AS line FROM twins WHERE rn = 1
    UNION ALL SELECT CASE WHEN sponsor_match = 'yes' THEN 'confirmed' ELSE 'others' END,
                     ord, {_LINE} FROM matched WHERE ord % 3 = 0
    UNION ALL SELECT 'top', ord, line FROM (
        SELECT ord, {_LINE} AS line FROM matched ORDER BY salary_max DESC, ord LIMIT 5) x""")
def _(t):
    rows = r.matched(t)
    return reports.run_summary(rows.filter("ord % 3 = 0"), rows)


def _case(number: str, table) -> str:
    bound, text = 0, "CASE"
    for name, share in table:
        bound += share
        text += f" WHEN {number} < {bound} THEN '{name}'"
    return text + " END"


@query("s23_synthetic_shapes", f"""
    SELECT shape, title_group, count(*) AS rows FROM (
        SELECT {_case('(c * 7919 + 13) % 100', searches.SHAPES)} AS shape,
               {_case('(c * 7919 + 31) % 100', searches.TITLE_MIX)} AS title_group
        FROM emp) x GROUP BY 1, 2""")
def _(t):
    ids = t.customer.select(F.col("c_custkey").alias("id"))
    return searches.synthetic_shapes(ids).groupBy("shape", "title_group") \
        .agg(F.count(F.lit(1)).alias("rows"))


@query("s23_synthetic_register", f"""
    SELECT shape, count(*) * 4 + sum(CASE shape WHEN 'absent' THEN 0 WHEN 'trap' THEN 2
                                     ELSE 1 END)::BIGINT AS rows
    FROM (SELECT {_case('(c * 7919 + 13) % 100', searches.SHAPES)} AS shape FROM emp) x
    GROUP BY 1""")
def _(t):
    ids = t.customer.select(F.col("c_custkey").alias("id"))
    return searches.synthetic_register(ids).groupBy("shape") \
        .agg(F.count(F.lit(1)).alias("rows"))


# --- projections ------------------------------------------------------------------------------

_MAPPED = ["id", "title", "company", "location", "contract_type", "category", "tier",
           "posted_date", "redirect_url", "status", "description", "source",
           "apply_deadline"]


@query("p1_greenhouse_rows", f"""
    SELECT 'gh:' || ord AS id, title, company, location, 'permanent' AS contract_type,
           'Eng, Data' AS category, {o.tier_of()} AS tier,
           CASE WHEN ord % 2 = 0 THEN date_first_seen ELSE posted_date END AS posted_date,
           'https://b.example/' || ord AS redirect_url, 'new' AS status,
           'Role ' || ord || ' R&D' AS description, 'gh' AS source, apply_deadline
    FROM postings WHERE source = 'gh'""")
def _(t):
    return r.postings_of(t, "greenhouse").select(*_MAPPED)


@query("p2_ashby_rows", f"""
    SELECT 'ashby:x' || ord AS id, title, company,
           location || CASE ord % 3 WHEN 0 THEN '; Remote (UK)' WHEN 1 THEN '; Leeds, Paris'
                       ELSE '' END AS location, 'part_time' AS contract_type,
           'Core' AS category, {o.tier_of()} AS tier, posted_date,
           'https://a.example/' || ord AS redirect_url, 'new' AS status,
           'Build things ' || ord AS description, 'ashby' AS source, '' AS apply_deadline
    FROM postings WHERE source = 'ashby'""")
def _(t):
    return r.postings_of(t, "ashby").select(*_MAPPED)


@query("p3_lever_rows", f"""
    SELECT 'lever:y' || ord AS id, title, company, location, 'internship' AS contract_type,
           'Dept' AS category, {o.tier_of()} AS tier, posted_date,
           'https://l.example/' || ord AS redirect_url, 'new' AS status,
           'Join team ' || ord AS description, 'lever' AS source, '' AS apply_deadline
    FROM postings WHERE source = 'lever'""")
def _(t):
    return r.postings_of(t, "lever").select(*_MAPPED)


@query("p4_aggregator_rows", """
    SELECT id, title, company, location, salary_max, 'permanent' AS contract_type,
           'IT Jobs' AS category, tier, posted_date, redirect_url,
           'A role R&D ' || ord AS description, 'new' AS status
    FROM postings WHERE source = 'adzuna'""")
def _(t):
    rows = feeds.aggregator_rows(feeds.aggregator_jobs(t.aggregated, "body", "ord", "tier"),
                                 TODAY, "tier", keep=["ord"])
    return rows.select("id", "title", "company", "location", "salary_max", "contract_type",
                       "category", "tier", "posted_date", "redirect_url", "description",
                       "status")


@query("p5_row_skeleton", """
    SELECT source, count(*) AS rows, CAST(22 AS BIGINT) AS columns,
           count(*) FILTER (title <> '') AS titled FROM postings
    WHERE source <> 'adzuna' GROUP BY source""")
def _(t):
    rows = feeds.board_rows(t.fetches, TODAY).drop("ord")
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(rows.columns)).alias("columns"),
        F.count_if(F.col("title") != "").alias("titled"))


@query("p6_family_dispatch", """
    SELECT CASE source WHEN 'gh' THEN 'gh:' || ord WHEN 'ashby' THEN 'ashby:x' || ord
                       ELSE 'lever:y' || ord END AS id, company
    FROM postings WHERE source <> 'adzuna'""")
def _(t):
    return feeds.board_rows(t.fetches, TODAY).select("id", "company")


_KIND = ("CASE ord % 7 WHEN 0 THEN 'Full Time' WHEN 1 THEN 'part-time' WHEN 2 THEN "
         "'Contract' WHEN 3 THEN ' INTERN ' WHEN 4 THEN '' WHEN 5 THEN 'Other' "
         "ELSE 'full_time' END")


@query("p7_contract_type", """
    SELECT ord, CASE ord % 7 WHEN 0 THEN 'permanent' WHEN 1 THEN 'part_time'
                WHEN 2 THEN 'contract' WHEN 3 THEN 'internship' WHEN 6 THEN 'permanent'
                ELSE '' END AS contract_type FROM postings""")
def _(t):
    raw = t.sql(f"SELECT ord, {_KIND} AS kind FROM postings")
    return raw.select("ord", tx.contract_type("kind").alias("contract_type"))


@query("p8_source_of", "SELECT ord, source FROM postings")
def _(t):
    return t.postings.select("ord", tx.source_of("id").alias("source"))


_STAMP = ("CASE ord % 6 WHEN 0 THEN posted_date || 'T10:00:00Z' WHEN 1 THEN "
          "CAST((11549 - ord % 121) * 86400 AS STRING) WHEN 2 THEN "
          "CAST((11549 - ord % 121) * 86400000 AS STRING) WHEN 3 THEN substring(posted_date, "
          "9, 2) || '/' || substring(posted_date, 6, 2) || '/' || substring(posted_date, 1, 4)"
          " WHEN 4 THEN 'not a date' ELSE posted_date END")


@query("p9_feed_date", """
    SELECT ord, CASE WHEN ord % 6 = 4 THEN '' ELSE posted_date END AS day FROM postings""")
def _(t):
    raw = t.sql(f"SELECT ord, {_STAMP} AS stamp FROM postings")
    return raw.select("ord", dates.mixed_date("stamp").alias("day"))


_JSON_STAMP = ("CASE ord % 9 WHEN 0 THEN CAST((11549 - ord % 121) * 86400 AS STRING) WHEN 1 THEN "
               "CAST((11549 - ord % 121) * 86400000 AS STRING) WHEN 2 THEN "
               "CAST((11549 - ord % 121) * 864 AS STRING) || 'e2' WHEN 3 THEN "
               "CAST(ord % 1000 AS STRING) WHEN 4 THEN '\"' || posted_date || 'T10:00:00Z\"' "
               "WHEN 5 THEN '\"' || CAST(986342400 + ord AS STRING) || '\"' WHEN 6 THEN 'true' "
               "WHEN 7 THEN '{\"at\":1}' ELSE CAST((11549 - ord % 121) * 86400 AS STRING) || '.5' "
               "END")


@query("p9_json_stamps", """
    SELECT ord, CASE ord % 9 WHEN 3 THEN '1970-01-01' WHEN 5 THEN '' WHEN 6 THEN ''
                     WHEN 7 THEN '' ELSE posted_date END AS day
    FROM postings""")
def _(t):
    raw = t.sql(f"SELECT ord, {_JSON_STAMP} AS stamp FROM postings")
    return raw.select("ord", dates.json_date(F.try_parse_json("stamp")).alias("day"))


@query("p6_order_of_jobs", """
    SELECT 'gh:' || ord || '-' || k AS id,
           row_number() OVER (ORDER BY ord, k) AS place
    FROM postings, (SELECT unnest(range(3)) AS k) n WHERE source = 'gh'""")
def _(t):
    # Several jobs a payload, and payload numbers far beyond 32 bits.
    body = F.expr("concat('{\"jobs\":[', array_join(transform(sequence(0, 2), k -> concat("
                  "'{\"id\":\"', ord, '-', k, '\"}')), ','), ']}')")
    log = t.fetches.filter("ats = 'greenhouse'").withColumn("body", body) \
        .withColumn("ord", F.col("ord") + F.lit(2 ** 62))
    rows = feeds.board_rows(log, TODAY).select("id", "ord")
    return number_by_range(rows, ["ord"], "place").select("id", "place")


_STORED = ("CASE ord % 5 WHEN 0 THEN posted_date || 'T10:00:00Z' WHEN 1 THEN posted_date || "
           "' 23:59:59' WHEN 2 THEN '2001-13-45' WHEN 3 THEN substring(posted_date, 9, 2) || "
           "'/' || substring(posted_date, 6, 2) || '/' || substring(posted_date, 1, 4) "
           "ELSE posted_date END")


@query("p10_parse_date", """
    SELECT ord, CASE WHEN ord % 5 = 2 THEN NULL ELSE posted_date END AS day FROM postings""")
def _(t):
    raw = t.sql(f"SELECT ord, {_STORED} AS stored FROM postings")
    return raw.select("ord", dates.parse_day("stored").cast("string").alias("day"))


@query("p11_age_days", f"""
    SELECT ord, CASE ord % 5 WHEN 2 THEN NULL
           ELSE {o.age('posted_date')} - CASE WHEN ord % 5 < 2 THEN 1 ELSE 0 END END AS age
    FROM postings""")
def _(t):
    raw = t.sql(f"SELECT ord, {_STORED} AS posted_date, '' AS date_first_seen FROM postings")
    return raw.select("ord", dates.age_days(TODAY).alias("age"))


_DECODED = "html"
for _entity, _char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"),
                       ("&gt;", ">"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_char}')"
_TAGLESS = "regexp_replace(html, '<[^>]+>', ' ', 'g')"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("p12_clean_snippet", f"""
    SELECT page_id, {_squeezed(_DECODED.replace('html', _TAGLESS, 1))} AS text
    FROM pages""")
def _(t):
    return t.pages.select("page_id", tx.clean_snippet("html").alias("text"))


@query("p13_clean_html", f"""
    SELECT page_id, {_squeezed(_DECODED.replace(
        'html', "regexp_replace(" + _DECODED + ", '<[^>]+>', ' ', 'g')", 1))} AS text
    FROM pages""")
def _(t):
    return t.pages.select("page_id", tx.clean_html("html").alias("text"))


@query("p14_decode_entities", f"SELECT page_id, {_DECODED} AS text FROM pages")
def _(t):
    return t.pages.select("page_id", tx.decode_entities("html").alias("text"))


@query("p14_decode_native", f"SELECT page_id, {_DECODED} AS text FROM pages")
def _(t):
    return t.pages.select("page_id", tx.decode_entities("html", exact=False).alias("text"))


@query("p15_normalize_name", f"""
    SELECT ord, {o.norm('org')} AS key FROM register
    UNION ALL SELECT -ord, {o.norm("company || ' & Co (UK) Ltd. LLP'")} FROM postings
    UNION ALL SELECT c_custkey, {o.norm("c_name || ' the Company'")} FROM customer""")
def _(t):
    part = t.register.select("ord", tx.normalize_name("org").alias("key"))
    more = t.postings.select((-F.col("ord")).alias("ord"), tx.normalize_name(
        F.concat("company", F.lit(" & Co (UK) Ltd. LLP"))).alias("key"))
    names = t.customer.select(F.col("c_custkey").alias("ord"), tx.normalize_name(
        F.concat("c_name", F.lit(" the Company"))).alias("key"))
    return part.unionByName(more).unionByName(names)


@query("p16_parse_rating", f"SELECT ord, {o.rating('type_rating')} AS rating FROM register")
def _(t):
    return t.register.select("ord", tx.parse_rating("type_rating").alias("rating"))


@query("p17_normalise", f"""
    SELECT doc_id, {o.plain(o.ascii_only('text'))} AS key FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.normalise(
        F.regexp_replace("text", "[^\\x00-\\x7F]", " ")).alias("key"))


@query("p18_twin_key", f"""
    SELECT ord, {o.twin('company')} AS company_key, {o.twin('title')} AS title_key
    FROM postings""")
def _(t):
    return t.postings.select("ord", tx.twin_key("company").alias("company_key"),
                             tx.twin_key("title").alias("title_key"))


@query("p19_as_int", """
    SELECT ord, CASE ord % 6 WHEN 0 THEN CAST(salary_max AS BIGINT)
                WHEN 1 THEN CAST(salary_max AS BIGINT) WHEN 2 THEN 0 WHEN 3 THEN 0
                WHEN 4 THEN 0 ELSE 1200 END AS salary FROM postings""")
def _(t):
    raw = t.postings.select("ord", F.expr(
        "CASE ord % 6 WHEN 0 THEN string(salary_max) WHEN 1 THEN concat(' ', "
        "string(bigint(salary_max)), '.9 ') WHEN 2 THEN 'n/a' WHEN 3 THEN 'nan' "
        "WHEN 4 THEN 'inf' ELSE '1.2e3' END").alias("raw"))
    return raw.select("ord", tx.as_int("raw").alias("salary"))


@query("p20_tier", f"SELECT ord, {o.tier_of()} AS tier FROM postings")
def _(t):
    return t.postings.select("ord", gates.tier_for_title().alias("tier"))


@query("p21_score", f"SELECT ord, {o.score()} AS score, {o.reasons()} AS reasons FROM matched")
def _(t):
    return shortlist.scored(r.matched(t), TODAY).select(
        "ord", "score", F.array_join("reasons", ", ").alias("reasons"))


@query("p22_clearance_hint", f"SELECT ord, {o.HINT} AS hint FROM postings")
def _(t):
    return t.postings.select("ord", gates.clearance_hint().alias("hint"))


@query("p23_job_summary", "SELECT * EXCLUDE (ord) FROM summaries")
def _(t):
    return views.job_summary(r.matched(t), TODAY)


@query("p24_job_detail", f"""
    SELECT m.id, {o.score()} AS score, {o.reasons()} AS reasons, {o.HINT} AS hint, x.method,
           x.register_name AS resolved_name, coalesce(g.n, 0) AS entries,
           coalesce(g.newest, 0) AS newest
    FROM matched m JOIN resolved x ON x.key = m.k
    LEFT JOIN (SELECT 'gh:' || (9990000000 + seq % 500) AS id, least(count(*), 20) AS n,
                      max(seq) AS newest FROM dlog GROUP BY 1) g ON g.id = m.id""")
def _(t):
    log = r.log(t).withColumn("entity", F.struct(
        F.lit("job").alias("kind"), F.concat(F.lit("gh:"), (F.col("seq") % 500 + 9990000000)
                                             .cast("string")).alias("id")))
    detail = views.job_detail(r.matched(t), r.lookup(t), t.aliases, t.boards, log, TODAY)
    return detail.select(
        "id", "score", F.array_join("score_reasons", ", ").alias("reasons"),
        F.col("clearance_hint").alias("hint"), "resolution.method",
        F.col("resolution.register_name").alias("resolved_name"),
        F.coalesce(F.size("trail"), F.lit(0)).alias("entries"),
        F.coalesce(F.try_element_at("trail", F.lit(1))["seq"], F.lit(0)).alias("newest"))


_PROFILE = """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN url
           ELSE 'site' || CAST(page_id AS STRING) || '.example' END AS blog,
           CASE WHEN page_id % 2 = 0 THEN 'p' || CAST(page_id AS STRING) || '@m.example'
                ELSE '' END AS email,
           CASE WHEN page_id % 5 = 0 THEN 'h' || CAST(page_id AS STRING) ELSE '' END
               AS twitter FROM pages"""


@query("p25_contact_routes", f"""
    SELECT page_id, concat_ws(' ', CASE WHEN blog = '' THEN NULL
             WHEN starts_with(blog, 'http') THEN 'website=' || blog
             ELSE 'website=https://' || blog END,
           CASE WHEN email <> '' THEN 'email=mailto:' || email END,
           CASE WHEN twitter <> '' THEN 'x=https://x.com/' || twitter END) AS routes
    FROM ({_PROFILE}) p""")
def _(t):
    routes = F.transform(pf.contact_routes(), lambda x: F.concat(x["kind"], F.lit("="),
                                                                 x["url"]))
    return t.sql(_PROFILE).select("page_id", F.array_join(routes, " ").alias("routes"))


@query("p26_route_whitelist", """
    SELECT page_id, concat_ws(' ', url, 'mailto:a@b.example') AS links FROM pages""")
def _(t):
    def route(url):
        return F.struct(F.lit("website").alias("kind"), url.alias("value"), url.alias("url"),
                        F.lit("").alias("note"))
    raw = t.pages.select("page_id", F.array(
        route(F.col("url")), route(F.concat(F.lit("javascript:"), "url")),
        route(F.lit(" mailto:a@b.example"))).alias("routes"))
    return raw.select("page_id", F.array_join(F.transform(
        pf.allowed_routes("routes"), lambda x: x["url"]), " ").alias("links"))


_FLAT = "regexp_replace(lower(name), '[^a-z0-9]', '', 'g')"
_DASHED = "trim(replace(lower(name), ' ', '-'), '-')"


@query("p27_org_slugs", f"""
    SELECT c, concat_ws(' ', {_FLAT}, CASE WHEN {_DASHED} <> {_FLAT} THEN {_DASHED} END,
           {_FLAT} || 'hq', {_FLAT} || '-oss') AS slugs FROM emp""")
def _(t):
    return t.emp.select("c", F.array_join(pf.org_slugs("name"), " ").alias("slugs"))


@query("p28_search_links", f"""
    SELECT c, {o.q(rules.PEOPLE_SEARCH_URL)} || replace(name, ' ', '+')
           || '+University+of+Nottingham' AS first_link,
           {o.q(rules.WEB_SEARCH_URL)} || 'site%3Agithub.com+%22' || replace(name, ' ', '+')
           || '%22+%22London%22' AS last_link,
           CAST({len(rules.PEOPLE_SEARCH_TERMS) + len(rules.XRAY_TERMS) + 3} AS BIGINT)
               AS links
    FROM emp""")
def _(t):
    built = t.emp.select("c", pf.search_links("name", F.lit("Data Engineer")).alias("l"))
    return built.select("c", F.element_at("l", 1)["url"].alias("first_link"),
                        F.element_at("l", -1)["url"].alias("last_link"),
                        F.size("l").alias("links"))


_RAW_NAME = ("CASE c % 5 WHEN 0 THEN 'xX_dev_' || CAST(c AS STRING) WHEN 1 THEN "
             "'Jean-Baptiste ' || name WHEN 2 THEN ' O''Neil ' WHEN 3 THEN '' "
             "ELSE name END")


@query("p29_first_name", """
    SELECT c, CASE c % 5 WHEN 0 THEN '' WHEN 1 THEN 'Jean-Baptiste' WHEN 2 THEN 'O''Neil'
                WHEN 3 THEN '' ELSE CASE WHEN regexp_full_match(split_part(name, ' ', 1),
                '[A-Za-z]+') THEN split_part(name, ' ', 1) ELSE '' END END AS first_name
    FROM emp""")
def _(t):
    raw = t.sql(f"SELECT c, {_RAW_NAME} AS person FROM emp")
    return raw.select("c", tx.first_name("person").alias("first_name"))


_QUESTION = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(title), {o.q(n)})" for n in needles)
    + f" THEN {o.q(text)}" for needles, text in rules.ROLE_QUESTIONS) \
    + f" ELSE {o.q(rules.DEFAULT_QUESTION)} END"


@query("p30_role_question", f"SELECT ord, {_QUESTION} AS question FROM postings")
def _(t):
    return t.postings.select("ord", pf.role_question("title").alias("question"))


def _ascii_text():
    return F.regexp_replace("text", "[^\\x00-\\x7F]", " ")


def _signal_sql() -> str:
    """Signals as a comma-joined text, ranked by weight, with the suppressions."""
    x = "txt"
    hit = {k: o.rx(x, p) for k, p in rules.SIGNAL_PATTERNS.items()}
    hit["uk"] = f"({hit['uk']} AND NOT {hit['london']})"
    placed = " OR ".join(hit[k] for k in rules.PLACE_SIGNALS)
    hit["india"] = f"({hit['india']} AND NOT ({placed}))"
    ranked = sorted(rules.SIGNALS, key=lambda s: -s[2])
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN {hit[k]} THEN '{k}' END" for k, *_ in ranked) + ")"


# Document texts with place words planted by id, so that every signal occurs.
_BIO = """
    SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') || CASE doc_id % 8
           WHEN 0 THEN ' London, UK' WHEN 1 THEN ' Mumbai India' WHEN 2 THEN ' Hindi'
           WHEN 3 THEN ' UoN' WHEN 4 THEN ' Surat' WHEN 5 THEN ' Wales'
           WHEN 6 THEN ' delhi' ELSE '' END AS txt FROM documents"""


def _bios(t):
    tail = F.expr("CASE doc_id % 8 WHEN 0 THEN ' London, UK' WHEN 1 THEN ' Mumbai India' "
                  "WHEN 2 THEN ' Hindi' WHEN 3 THEN ' UoN' WHEN 4 THEN ' Surat' "
                  "WHEN 5 THEN ' Wales' WHEN 6 THEN ' delhi' ELSE '' END")
    return t.documents.select("doc_id", F.concat(_ascii_text(), tail).alias("txt"))


@query("p31_priority_pick", f"""
    SELECT doc_id, coalesce(list_filter({rules.HOOK_PRIORITY!r},
           lambda k: list_contains(string_split(s, ','), k))[1], '') AS opening
    FROM (SELECT doc_id, {_signal_sql()} AS s FROM ({_BIO}) b) x""")
def _(t):
    tagged = _bios(t).select("doc_id", pf.matched_signals("txt").alias("s"))
    return tagged.select("doc_id", pf.opening_key("s").alias("opening"))


@query("p32_first_fit", """
    SELECT ord, CASE WHEN length(a) <= 60 THEN a WHEN length(b) <= 60 THEN b ELSE z END
               AS note
    FROM (SELECT ord, title || ' at ' || company || ' in ' || location AS a,
                 title || ' at ' || company AS b, company AS z FROM postings) x""")
def _(t):
    notes = pf.first_fit(F.concat_ws("  ", "title", F.lit("at"), "company", F.lit("in"),
                                     "location"),
                         F.concat_ws(" ", "title", F.lit(" at"), "company"),
                         F.col("company"), limit=60)
    return t.postings.select("ord", notes.alias("note"))


@query("p33_slug", f"""
    SELECT doc_id, substring(trim(regexp_replace(lower({o.ascii_only('text')}),
           '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.slug(_ascii_text()).alias("slug"))


_SNIP = "trim(regexp_replace(txt, '\\s+', ' ', 'g'))"


@query("p34_evidence", f"""
    SELECT doc_id, CASE WHEN {o.rx('txt', rules.SIGNAL_PATTERNS['london'])} THEN
           'bio: ' || CASE WHEN length({_SNIP}) > 120 THEN substring({_SNIP}, 1, 117)
           || '...' ELSE {_SNIP} END ELSE '' END AS london
    FROM ({_BIO}) b""")
def _(t):
    tagged = _bios(t).withColumn("s", pf.matched_signals("txt"))
    found = tagged.withColumn("e", pf.signal_evidence("s", {"bio": "txt"}))
    return found.select("doc_id", F.coalesce(F.try_element_at("e", F.lit("london")),
                                             F.lit("")).alias("london"))


@query("p35_append_note", f"""
    SELECT ord, CASE WHEN ord % 3 = 0 THEN location
                ELSE CASE WHEN ord % 2 = 0 THEN location || chr(10) ELSE '' END
                     || '{AS_OF}: ' || title END AS notes FROM postings""")
def _(t):
    existing = F.when((F.col("ord") % 2 == 0) | (F.col("ord") % 3 == 0), F.col("location")) \
        .otherwise("")
    note = F.when(F.col("ord") % 3 == 0, "  ").otherwise(F.col("title"))
    return t.postings.select("ord", tx.append_note(existing, note, dates.as_date(TODAY))
                             .alias("notes"))


@query("p36_row_digest", """
    SELECT seq, 'sha256:' || sha256('{"action_id":"' || action_id || '","seq":' || seq
           || ',"type":"' || type || '"}') AS digest FROM dlog""")
def _(t):
    body = audit.canonical(t.dlog, ["seq", "type", "action_id"])
    return t.dlog.select("seq", audit.digest(body).alias("digest"))


@query("p36_line_digest", """
    SELECT seq, 'sha256:' || sha256('{"id":"' || id || '","seq":' || seq || '}') AS digest
    FROM dlog""")
def _(t):
    lines = t.sql("SELECT seq, '{\"seq\": ' || CAST(seq AS STRING) || ', \"id\": \"' || id "
                  "|| '\", \"hash\": \"x\"}' AS raw FROM dlog")
    return lines.select("seq", audit.line_digest("raw").alias("digest"))


@query("p37_company_detail", """
    SELECT 'job' AS part, id AS item, disqualified_reason AS detail FROM summaries
    WHERE trim(company) = 'Tarnbrook1 Foundry'
    UNION ALL SELECT 'suggestion', candidate, CASE rule WHEN 0 THEN 'prefix'
                     ELSE 'trading-as' END FROM top3 WHERE key = 'TARNBROOK1 FOUNDRY'
    UNION ALL SELECT 'summary', company, CAST(jobs AS VARCHAR) FROM companies
              WHERE company = 'Tarnbrook1 Foundry'
    UNION ALL SELECT 'trail', id, type FROM (SELECT * FROM dlog
              WHERE upper(company) = 'TARNBROOK1 FOUNDRY' ORDER BY seq DESC LIMIT 20) d""")
def _(t):
    parts = views.company_detail(r.matched(t), "Tarnbrook1 Foundry", r.lookup(t), t.aliases,
                                 t.boards, t.rejections, r.log(t), TODAY)
    return parts["jobs"].select(F.lit("job").alias("part"), F.col("id").alias("item"),
                                F.col("disqualified_reason").alias("detail")) \
        .unionByName(parts["suggestions"].select(
            F.lit("suggestion").alias("part"), F.col("candidate").alias("item"),
            F.col("why").alias("detail"))) \
        .unionByName(parts["summary"].select(
            F.lit("summary").alias("part"), F.col("company").alias("item"),
            F.col("jobs").cast("string").alias("detail"))) \
        .unionByName(parts["trail"].select(
            F.lit("trail").alias("part"), F.col("id").alias("item"),
            F.col("type").alias("detail")))


# --- filters and predicates ---------------------------------------------------------------------

@query("f1_word_pattern", f"""
    SELECT doc_id, {o.rx(o.ascii_only('text'), r"\b(the|und|que)\b")} AS hit
    FROM documents""")
def _(t):
    pattern = rules.word_pattern(["the", "und", "que"])
    return t.documents.select("doc_id", tx.has(_ascii_text(), pattern).alias("hit"))


@query("f2_noise_title", f"""
    SELECT p_partkey, {o.rx("p_name || ' lift engineer fire ' || p_type",
                            rules.NOISE_PATTERN)} AS noise,
           {o.rx('p_name', rules.NOISE_PATTERN)} AS plain FROM part""")
def _(t):
    return t.part.select(
        "p_partkey", gates.is_noise(F.concat("p_name", F.lit(" lift engineer fire "),
                                             "p_type")).alias("noise"),
        gates.is_noise("p_name").alias("plain"))


@query("f3_too_senior", f"""
    SELECT ord, {o.rx('title', rules.INGEST_SENIORITY_PATTERN)} AS senior FROM postings""")
def _(t):
    return t.postings.select("ord", gates.is_too_senior().alias("senior"))


@query("f4_unsuitable_reason", f"SELECT ord, {o.unsuitable()} AS reason FROM postings")
def _(t):
    return t.postings.select("ord", gates.unsuitable_reason().alias("reason"))


@query("f5_agency", f"SELECT ord, {o.agency()} AS agency FROM postings")
def _(t):
    return t.postings.select("ord", gates.is_agency().alias("agency"))


@query("f6_apply_ready_reason", f"SELECT ord, {o.apply_ready()} AS reason FROM matched")
def _(t):
    return r.matched(t).select("ord", gates.apply_ready_reason().alias("reason"))


@query("f7_disqualify", f"""
    SELECT ord, {o.disqualified(30)} AS gated, {o.disqualified()} AS ungated FROM matched""")
def _(t):
    return r.matched(t).select("ord", gates.disqualify(TODAY, 30).alias("gated"),
                               gates.disqualify().alias("ungated"))


@query("f8_title_classes", f"""
    SELECT ord, {o.rx('title', rules.TECH_SIGNAL_PATTERN)} AS tech,
           {o.rx('title', rules.NON_TECH_PATTERN)} AS non_tech,
           {o.rx('title', rules.FDE_PATTERN)} AS fde, {o.rx('title', rules.GRAD_PATTERN)}
               AS grad, {o.rx('title', rules.AI_PATTERN)} AS ai FROM postings""")
def _(t):
    return t.postings.select(
        "ord", gates.is_tech().alias("tech"), gates.is_non_tech().alias("non_tech"),
        tx.has("title", rules.FDE_PATTERN).alias("fde"),
        tx.has("title", rules.GRAD_PATTERN).alias("grad"),
        tx.has("title", rules.AI_PATTERN).alias("ai"))


@query("f9_uk_location", f"SELECT ord, {o.location_reason()} AS reason FROM postings")
def _(t):
    return t.postings.select("ord", gates.uk_location_reason().alias("reason"))


@query("f10_ingest_reason", f"SELECT ord, {o.ingest_reason()} AS reason FROM postings")
def _(t):
    return t.postings.select("ord", gates.drop_reason(TODAY).alias("reason"))


@query("f11_route_filter", """
    SELECT ord, org FROM register WHERE trim(route) = 'Skilled Worker'""")
def _(t):
    return t.register.filter(tx.strip("route") == rules.SKILLED_WORKER_ROUTE) \
        .select("ord", "org")


@query("f12_active_boards", """
    SELECT slug, status FROM boards WHERE status IN ('active', 'empty', '')
      AND ats = 'lever'""")
def _(t):
    return tables.active_boards(t.boards, family="lever").select("slug", "status")


@query("f13_job_filter", """
    SELECT id, score FROM summaries WHERE contains(lower(title || ' ' || company), 'data')
      AND tier = '2' AND sponsor_match = 'yes' AND eligible""")
def _(t):
    jobs = views.job_summary(r.matched(t), TODAY)
    return views.filter_jobs(jobs, q="Data", tier="2", sponsor="yes", eligible=True) \
        .select("id", "score")


@query("f13_indexed_job_filter", """
    SELECT id, score FROM summaries WHERE contains(lower(title || ' ' || company), 'ta eng')
      AND sponsor_match = 'yes'""")
def _(t):
    jobs = views.job_summary(r.matched(t), TODAY)
    return views.filter_jobs(jobs, q="TA Eng", sponsor="yes", index=views.job_index(t.postings)) \
        .select("id", "score")


@query("f14_company_filter", """
    SELECT c.company, c.jobs FROM companies c JOIN resolved x ON x.key = c.key
    WHERE contains(lower(c.company), 'pumice') AND x.method <> 'none'""")
def _(t):
    companies = views.company_summary(r.matched(t), r.lookup(t), t.aliases, t.boards)
    return views.filter_companies(companies, q="Pumice", resolved=True) \
        .select("company", "jobs")


@query("f15_log_filter", """
    SELECT seq, id FROM dlog WHERE type = 'alias.confirm' AND seq < 5000
    ORDER BY seq DESC LIMIT 100""")
def _(t):
    return audit.read_log(r.log(t), type="alias.confirm", before_seq=5000, limit=100) \
        .select("seq", "id")


_ASKS = " || ' ' || ".join(
    f"CASE WHEN regexp_matches(lower(x), {o.q(p)}) THEN 'ask' ELSE '' END"
    for p in rules.ASK_PATTERNS)
_DRAFT = ("text || CASE doc_id % 4 WHEN 0 THEN ' could you refer me' WHEN 1 THEN "
          "' a -- b' WHEN 2 THEN ' any openings?' ELSE '' END")


@query("f16_text_lint", f"""
    SELECT doc_id, len(string_split({_ASKS}, 'ask')) - 1
           + CASE WHEN contains(x, ' -- ') THEN 1 ELSE 0 END AS warnings
    FROM (SELECT doc_id, {o.ascii_only('(' + _DRAFT + ')')} AS x FROM documents) d""")
def _(t):
    draft = t.documents.select("doc_id", F.regexp_replace(F.expr(_DRAFT), "[^\\x00-\\x7F]", " ").alias("x"))
    return draft.select("doc_id", F.size(pf.lint_warnings("x")).alias("warnings"))


@query("f17_rationale_rule", """
    SELECT doc_id, length(trim(x)) BETWEEN 10 AND 500 AS ok,
           length(trim(x)) || ' chars' AS detail
    FROM (SELECT doc_id, regexp_replace(text, '[\\s]', 'a', 'g') AS x FROM documents) d""")
def _(t):
    reason = F.regexp_replace("text", "\\s", "a")
    failing, good = decisions.rationale_check(reason)
    return t.documents.select("doc_id", (~failing).alias("ok"), good["detail"].alias("detail"))


@query("f18_contact_status", """
    SELECT ord, status IN ('found', 'contacted', 'replied', 'referred', 'declined')
           AND ord % 9 <> 0 AS known FROM touches""")
def _(t):
    raw = t.touches.withColumn("status", F.when(F.col("ord") % 9 == 0, "zzz")
                               .otherwise(F.col("status")))
    changes = raw.select("ord", F.col("ord").cast("string").alias("id"), "status")
    judged = decisions.judge_contact_changes(changes.select("id"), changes)
    return judged.select("ord", (F.col("code") == "").alias("known"))


@query("f19_point_lookup", f"""
    SELECT id, company FROM postings
    WHERE {o.norm('company')} = 'PUMICE1 METRICS' OR id = '9990000001'""")
def _(t):
    by_key = views.company_by_key(t.postings, "Pumice1 Metrics")
    by_id = views.job_by_id(t.postings, "9990000001")
    return by_key.unionByName(by_id).select("id", "company").distinct()


@query("f20_untracked_filtered", f"""
    SELECT reason, count(*) AS rows FROM (
        SELECT {o.unsuitable()} AS reason FROM feed
        WHERE id NOT IN (SELECT id FROM store)) f WHERE reason IS NOT NULL GROUP BY 1""")
def _(t):
    return store.filtered_untracked(t.feed, t.store)
