"""SQL building blocks for the oracle side of every query (DuckDB dialect).

Nothing here is used by the Spark side; it restates the rules in plain SQL so that the two
can be compared.
"""
from __future__ import annotations

import re

from licmatch import rules
from licmatch.plans import fixtures as fx
from licmatch.plans.fixtures import AS_OF

TODAY = f"DATE '{AS_OF}'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(column: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({column}, {q(flags + pattern)})"


def norm(x: str) -> str:
    legal = "|".join(rules.LEGAL_SUFFIXES)
    return (f"regexp_replace(regexp_replace(trim(regexp_replace(replace(upper({x}), '&', "
            f"' AND '), '[^A-Z0-9]+', ' ', 'g')), '^THE ', ''), "
            f"'(?:(?:^| )(?:{legal}))+$', '')")


def rating(x: str) -> str:
    return f"upper(regexp_extract({x}, {q('(?i)' + rules.RATING_PATTERN)}, 1))"


def plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def twin(x: str) -> str:
    words = "|".join(rules.TWIN_KEY_WORDS)
    return (f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g'), "
            f"'\\b({words})\\b', '', 'g'))")


def ascii_only(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', ' ', 'g')"


def agency(x: str = "company") -> str:
    names = " OR ".join(f"contains(lower({x}), {q(n)})" for n in rules.RECRUITER_COMPANIES)
    return f"({rx(x, rules.RECRUITER_KEYWORD_PATTERN)} OR {names})"


def tech_role(x: str = "title") -> str:
    return (f"({rx(x, rules.TECH_SIGNAL_PATTERN)} AND NOT {rx(x, rules.NON_TECH_PATTERN)})")


def age(column: str, as_of: str = TODAY) -> str:
    return f"date_diff('day', CAST({column} AS DATE), {as_of})"


def unsuitable(x: str = "title") -> str:
    return (f"CASE WHEN {rx(x, rules.NOISE_PATTERN)} THEN 'trades/construction noise' "
            f"WHEN {rx(x, rules.INGEST_SENIORITY_PATTERN)} THEN 'too senior' END")


def disqualified(max_age: int | None = None, match: str = "sponsor_match") -> str:
    gate = (f"WHEN source = 'adzuna' AND {age('posted_date')} > {max_age} "
            f"THEN 'older than {max_age}d (likely closed)' " if max_age is not None else "")
    t = "title"
    return (
        "CASE WHEN lower(trim(status)) NOT IN ('', 'new') THEN 'already actioned (status=' "
        f"|| lower(trim(status)) || ')' {gate}"
        f"WHEN {rx(t, rules.SENIORITY_PATTERN)} THEN 'seniority title — early-career profile' "
        f"WHEN {rx(t, rules.CLEARANCE_PATTERN)} "
        "THEN 'security clearance / nationality requirement' "
        f"WHEN {rx(t, rules.APPLY_BLOCK_PATTERN)} "
        "THEN 'internship/apprenticeship — needs a later graduation year' "
        f"WHEN lower(trim({match})) <> 'yes' THEN 'no sponsor-register match' "
        f"WHEN {rx(t, rules.NON_TECH_PATTERN)} "
        "THEN 'non-software trade/role (tracker tier unreliable)' "
        f"WHEN NOT {rx(t, rules.TECH_SIGNAL_PATTERN)} THEN 'no tech signal in title' END")


def apply_ready() -> str:
    t = "title"
    return (
        "CASE WHEN lower(trim(status)) NOT IN ('', 'new') THEN 'already actioned (' || "
        "lower(trim(status)) || ')' "
        "WHEN sponsor_match <> 'yes' THEN 'not sponsor-confirmed' "
        f"WHEN {agency()} THEN 'recruiter/agency posting' "
        f"WHEN {rx(t, rules.NOISE_PATTERN)} THEN 'trades/construction noise' "
        f"WHEN {rx(t, rules.INGEST_SENIORITY_PATTERN)} THEN 'too senior' "
        f"WHEN {rx(t, rules.APPLY_BLOCK_PATTERN)} "
        "THEN 'won''t sponsor in practice (cleared/apprentice/intern)' "
        f"WHEN NOT {rx(t, rules.ROLE_INCLUDE_PATTERN)} "
        "THEN 'off-target role (not software/AI/data)' END")


def location_reason(location: str = "location", title: str = "title") -> str:
    both = f"trim({title} || ' ' || {location})"
    foreign = f"regexp_extract({both}, {q('(?i)' + rules.FOREIGN_PATTERN)}, 0)"
    state = f"regexp_extract({both}, {q(rules.US_STATE_PATTERN)}, 0)"
    weak = rules.UK_WEAK_PATTERN.replace("(?<!new )york", "york")
    rest = (f"trim(regexp_replace(regexp_replace({location}, "
            f"{q('(?i)' + rules.ARRANGEMENT_PATTERN)}, ' ', 'g'), '(?i)[^a-z]+', ' ', 'g'))")
    return (
        f"CASE WHEN {both} = '' OR {rx(both, rules.UK_STRONG_PATTERN)} THEN NULL "
        f"WHEN {foreign} <> '' THEN 'not a UK location (' || trim({foreign}, ', ') || ')' "
        f"WHEN {state} <> '' THEN 'not a UK location (' || trim({state}, ', ') || ')' "
        f"WHEN regexp_matches(replace(lower({both}), 'new york', ''), {q('(?i)' + weak)}) "
        f"OR trim({location}) = '' OR {rest} = '' THEN NULL "
        f"ELSE 'not a UK location (' || substring(trim({location}), 1, 40) || ')' END")


def ingest_reason() -> str:
    return (f"coalesce({unsuitable()}, "
            f"CASE WHEN {rx('title', rules.NON_TECH_PATTERN)} THEN 'non-software role' "
            f"WHEN NOT {rx('title', rules.TECH_SIGNAL_PATTERN)} "
            f"THEN 'no tech signal in title' END, {location_reason()}, "
            f"CASE WHEN apply_deadline <> '' AND apply_deadline < '{AS_OF}' "
            "THEN 'deadline passed (' || apply_deadline || ')' END)")


def tier_of(x: str = "title") -> str:
    return (f"CASE WHEN {rx(x, rules.FDE_PATTERN)} THEN '1' "
            f"WHEN {rx(x, rules.AI_PATTERN)} THEN '3' "
            f"WHEN {rx(x, rules.GRAD_PATTERN)} AND {rx(x, rules.TECH_SIGNAL_PATTERN)} "
            f"THEN '2' WHEN {rx(x, rules.TECH_SIGNAL_PATTERN)} THEN '4' ELSE '' END")


def _score_terms() -> list[tuple[str, int, str]]:
    seen = age("date_first_seen")
    floor = "CAST(trunc(salary_min) AS BIGINT)"
    return [(f"tier = '{t}'", p, f"'tier {t}'") for t, p in rules.TIER_SCORE.items()] + [
        (rx("title", rules.FDE_PATTERN), 30, "'forward-deployed/solutions title'"),
        (rx("title", rules.GRAD_PATTERN), 20, "'early-career title'"),
        (rx("title", rules.AI_PATTERN), 10, "'AI/ML title'"),
        ("upper(trim(sponsor_rating)) = 'A'", 10, "'A-rated sponsor'"),
        ("contains(lower(location), 'london')", 10, "'London'"),
        (agency(), -25, "'agency listing (real employer hidden)'"),
        (f"{floor} >= 90000", -20,
         f"'salary floor £' || format('{{:,}}', {floor}) || ' suggests senior'"),
        (f"{seen} <= 7", 10, "'posted this week'"),
        (f"{seen} > 30", -10, f"{seen} || 'd old'"),
    ]


def score() -> str:
    terms = " + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0 END)" for c, p, _ in _score_terms())
    return f"CAST({terms} AS BIGINT)"


def reasons() -> str:
    return "concat_ws(', ', " + ", ".join(
        f"CASE WHEN {c} THEN {r} END" for c, _, r in _score_terms()) + ")"


HINT = f"regexp_extract(description, {q('(?i)' + rules.CLEARANCE_HINT_PATTERN)}, 0)"
LONDON = "CASE WHEN contains(lower(location), 'london') THEN 0 ELSE 1 END"

CTES: dict[str, str] = {
    "lk": f"""
        SELECT key, CASE WHEN bool_or(rating = 'A') THEN 'A' ELSE arg_min(rating, ord) END
                    AS rating, min(ord) AS ord
        FROM (SELECT {norm('org')} AS key, {rating('type_rating')} AS rating, ord
              FROM register WHERE trim(route) = 'Skilled Worker') r
        WHERE key <> '' GROUP BY key""",
    "al": f"""
        SELECT {norm('company')} AS key, arg_max(register_name, ord) AS register_name,
               arg_max(rating, ord) AS rating, arg_max(actor, ord) AS actor,
               arg_max(confirmed, ord) AS confirmed, arg_max(rationale, ord) AS rationale
        FROM aliases GROUP BY 1""",
    "matched": f"""
        SELECT p.* EXCLUDE (sponsor_match, sponsor_rating, sponsor_route),
               CASE WHEN a.key IS NOT NULL OR l.key IS NOT NULL THEN 'yes' ELSE 'no' END
                   AS sponsor_match,
               CASE WHEN a.key IS NOT NULL THEN coalesce(ra.rating, a.rating)
                    ELSE coalesce(l.rating, '') END AS sponsor_rating,
               CASE WHEN a.key IS NOT NULL OR l.key IS NOT NULL THEN 'Skilled Worker'
                    ELSE '' END AS sponsor_route
        FROM (SELECT *, {norm('company')} AS k FROM postings) p
        LEFT JOIN al a ON a.key = p.k LEFT JOIN lk l ON l.key = p.k
        LEFT JOIN lk ra ON ra.key = {norm('a.register_name')}""",
    "exact_matched": f"""
        SELECT p.* EXCLUDE (sponsor_match, sponsor_rating, sponsor_route),
               CASE WHEN l.key IS NOT NULL THEN 'yes' ELSE 'no' END AS sponsor_match,
               coalesce(l.rating, '') AS sponsor_rating,
               CASE WHEN l.key IS NOT NULL THEN 'Skilled Worker' ELSE '' END
                   AS sponsor_route
        FROM (SELECT *, {norm('company')} AS k FROM postings) p
        LEFT JOIN lk l ON l.key = p.k""",
    # Suggestions by plain scanning of the whole register, as a theta join.
    "openkeys": f"""
        SELECT DISTINCT {norm('company')} AS key FROM postings
        WHERE length({norm('company')}) >= 4
          AND {norm('company')} NOT IN (SELECT key FROM lk)""",
    "hits": """
        SELECT k.key, 0 AS rule, l.key AS candidate, l.rating, l.ord
        FROM openkeys k JOIN lk l ON split_part(l.key, ' ', 1) = split_part(k.key, ' ', 1)
             AND starts_with(l.key || ' ', k.key || ' ')
        UNION ALL
        SELECT k.key, 1, l.key, l.rating, l.ord
        FROM openkeys k JOIN lk l ON contains(l.key, ' T A ')
             AND split_part(substring(l.key, strpos(l.key, ' T A ') + 5), ' ', 1)
                 = split_part(k.key, ' ', 1)
             AND contains(' ' || l.key || ' ', ' T A ' || k.key || ' ')""",
    "top3": """
        SELECT key, rule, candidate, rating, ord, rn FROM (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY rule, ord) AS rn
            FROM hits) h WHERE rn <= 3""",
    "ruled": f"""
        SELECT * FROM (
            SELECT s.ck, s.tk, r.verdict, r.reason, r.verified,
                   row_number() OVER (PARTITION BY s.ck, s.tk
                                      ORDER BY r.rank, r.ord) AS rn
            FROM (SELECT DISTINCT {plain('company')} AS ck, {plain('title')} AS tk
                  FROM postings) s
            JOIN (SELECT CASE WHEN kind = 'role' THEN 0 ELSE 1 END AS rank, ord, verdict,
                         reason, verified,
                         {plain("split_part(ruling_key, '::', 1)")} AS dc,
                         CASE WHEN kind = 'role'
                              THEN {plain("split_part(ruling_key, '::', 2)")}
                              ELSE '' END AS dt FROM rulings) r
              ON contains(s.ck, r.dc) AND contains(s.tk, r.dt)) x WHERE rn = 1""",
    "gated": f"""
        SELECT m.*, {disqualified(30)} AS gate, {agency()} AS is_ag, r.verdict, r.reason
                   AS ruling_reason, {plain('title')} AS tkey, {plain('company')} AS ckey
        FROM matched m LEFT JOIN ruled r ON r.ck = {plain('m.company')}
             AND r.tk = {plain('m.title')}""",
    "firsts": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY tkey, ckey ORDER BY ord) AS listing
            FROM gated WHERE gate IS NULL AND coalesce(verdict, '') <> 'CUT' AND NOT is_ag
        ) g WHERE listing = 1""",
    "ranked": f"SELECT *, {score()} AS score, {reasons()} AS reasons FROM firsts",
    "ready": f"""
        SELECT *, {twin('company')} AS tc, {twin('title')} AS tt FROM matched
        WHERE {apply_ready()} IS NULL""",
    "twins": f"""
        SELECT *, min(ord) OVER (PARTITION BY tc, tt) AS first_ord,
               row_number() OVER (PARTITION BY tc, tt
                                  ORDER BY {LONDON}, -salary_max, ord) AS rn FROM ready""",
    "summaries": f"""
        SELECT ord, id, title, company, location, tier, status,
               CASE WHEN contains(id, ':') THEN split_part(id, ':', 1) ELSE 'adzuna' END
                   AS source, posted_date, CAST({age('posted_date')} AS BIGINT) AS age_days,
               salary_max, sponsor_match, sponsor_rating, redirect_url, {score()} AS score,
               {disqualified()} IS NULL AS eligible, {disqualified()} AS disqualified_reason
        FROM matched""",
    "companies": f"""
        SELECT trim(company) AS company, {norm('trim(company)')} AS key,
               count(*) AS jobs, count(*) FILTER ({tech_role()}) AS tech_jobs,
               array_to_string(list_sort(list(DISTINCT tier)), ',') AS tiers,
               {agency('trim(company)')} AS is_agency
        FROM matched GROUP BY trim(company)""",
    "resolved": f"""
        SELECT k.key,
               CASE WHEN a.key IS NOT NULL THEN 'alias' WHEN b.key IS NOT NULL THEN 'board'
                    WHEN l.key IS NOT NULL THEN 'exact' ELSE 'none' END AS method,
               CASE WHEN a.key IS NOT NULL THEN a.register_name
                    WHEN b.key IS NOT NULL THEN b.register_name
                    WHEN l.key IS NOT NULL THEN l.key ELSE '' END AS register_name,
               CASE WHEN a.key IS NOT NULL THEN a.rating
                    WHEN b.key IS NOT NULL THEN coalesce(lb.rating, '')
                    ELSE coalesce(l.rating, '') END AS rating,
               coalesce(a.actor, '') AS confirmed_by,
               coalesce(a.confirmed, '') AS confirmed_at
        FROM (SELECT DISTINCT {norm('company')} AS key FROM postings) k
        LEFT JOIN al a ON a.key = k.key
        LEFT JOIN (SELECT {norm('company')} AS key, arg_max(register_name, ord)
                          AS register_name FROM boards WHERE register_name <> ''
                   GROUP BY 1) b ON b.key = k.key
        LEFT JOIN lk l ON l.key = k.key
        LEFT JOIN lk lb ON lb.key = {norm('b.register_name')}""",
    # Companies with an unmatched row that are neither agencies nor aliased.
    "cands": f"""
        SELECT c.company, {norm('c.company')} AS key, c.nrows, c.tiers, c.ntech, c.tcount
        FROM (SELECT trim(company) AS company, count(*) AS nrows,
                     count(*) FILTER ({tech_role()}) AS ntech,
                     coalesce(array_to_string(list_sort(list(DISTINCT tier)
                         FILTER (tier IN ('1', '2', '3'))), '/'), '') AS tiers,
                     count(DISTINCT tier) FILTER (tier IN ('1', '2', '3')) AS tcount,
                     count(*) FILTER (sponsor_match = 'no') AS nno
              FROM exact_matched GROUP BY 1) c
        WHERE c.nno > 0 AND NOT {agency('c.company')}
          AND {norm('c.company')} NOT IN (SELECT key FROM al)
          AND {norm('c.company')} IN (SELECT key FROM top3)""",
    "ttitles": f"""
        SELECT company, title, ord, rn FROM (
            SELECT trim(company) AS company, title, ord,
                   row_number() OVER (PARTITION BY trim(company) ORDER BY ord) AS rn
            FROM exact_matched WHERE {tech_role()}) t WHERE rn <= 3""",
    "judged": f"""
        SELECT f.*, coalesce({ingest_reason()},
                             CASE WHEN f.id IN (SELECT id FROM store)
                                  THEN 'already tracked' END) AS drop_reason
        FROM feed f WHERE source <> 'adzuna'""",
    "live": """
        SELECT company, arg_max(type, seq) AS type, arg_max(register_name, seq)
                   AS register_name, arg_max(rating, seq) AS rating,
               arg_max(day, seq) AS confirmed, arg_max(actor, seq) AS actor,
               arg_max(rationale, seq) AS rationale, arg_max(id, seq) AS log_entry_id
        FROM dlog WHERE type IN ('alias.confirm', 'alias.reject')
          AND id NOT IN (SELECT target_id FROM dlog WHERE type LIKE '%.undone')
        GROUP BY company""",
}


def _names(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_0-9]+", sql))
    return [n for n in CTES if n in words]


def statement(sql: str) -> str:
    """A self-contained oracle statement: derived tables and rule relations prepended."""
    wanted: set[str] = set()

    def need(text: str) -> None:
        for name in _names(text):
            if name not in wanted:
                wanted.add(name)
                need(CTES[name])
    need(sql)
    extra = {n: CTES[n] for n in CTES if n in wanted}
    text = " ".join([sql, *extra.values()])
    shared: set[str] = set()
    fx._collect(text, shared)
    parts = [f"{n} AS ({fx.CTES[n]})" for n in fx.CTES if n in shared]
    parts += [f"{n} AS MATERIALIZED ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
