"""Shared-background signals, contact routes, search links and first-message picks."""
from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

from licmatch import rules
from licmatch.functions.text import blank, col, has, strip, tidy, url_quote_plus


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def matched_signals(*texts: Column | str) -> Column:
    """Keys of the signals a person's own words show, strongest first.

    A city suppresses the country: london hides uk, a named place hides india.
    """
    blob = F.concat_ws(" ", *[F.nullif(col(t), F.lit("")) for t in texts])
    ranked = sorted(rules.SIGNALS, key=lambda s: -s[2])
    hits = {key: has(blob, rules.SIGNAL_PATTERNS[key]) for key, *_ in rules.SIGNALS}
    placed = functools.reduce(lambda a, b: a | b, [hits[k] for k in rules.PLACE_SIGNALS])
    shown = {**hits, "uk": hits["uk"] & ~hits["london"], "india": hits["india"] & ~placed}
    return F.array_compact(F.array(*[F.when(shown[key], F.lit(key))
                                     for key, *_ in ranked]))


def signal_weight(signals: Column | str) -> Column:
    weights = F.create_map(*[F.lit(x) for key, _, w, _ in rules.SIGNALS for x in (key, w)])
    return F.aggregate(col(signals), F.lit(0),
                       lambda acc, k: acc + F.coalesce(F.try_element_at(weights, k),
                                                       F.lit(0)))


def signal_labels(signals: Column | str) -> Column:
    labels = F.create_map(*[F.lit(x) for key, lab, _, _ in rules.SIGNALS for x in (key, lab)])
    return F.transform(col(signals), lambda k: F.try_element_at(labels, k))


def signal_evidence(signals: Column | str, fields: dict[str, Column | str]) -> Column:
    """signal key -> 'field: text' for the first field that shows the signal."""
    def snippet(name: str, text: Column) -> Column:
        flat = strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
        cut = F.when(F.length(flat) > 120, F.concat(F.substring(flat, 1, 117), F.lit("...")))
        return F.concat(F.lit(f"{name}: "), F.coalesce(cut, flat))

    entries = []
    for key, *_ in rules.SIGNALS:
        shown = F.coalesce(*[F.when(has(text, rules.SIGNAL_PATTERNS[key]),
                                    snippet(name, col(text)))
                             for name, text in fields.items()])
        entries.append(F.when(F.array_contains(col(signals), key) & shown.isNotNull(),
                              F.struct(F.lit(key).alias("key"), shown.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def contact_routes(blog="blog", email="email", twitter="twitter") -> Column:
    """Published ways to reach a person, most welcome first."""
    def route(kind, value, url, note):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), url.alias("url"),
                        F.lit(note).alias("note"))
    b, e, t = blank(blog), blank(email), blank(twitter)
    site = F.when(F.lower(b).rlike("^https?://"), b).otherwise(F.concat(F.lit("https://"), b))
    return F.array_compact(F.array(
        F.when(b != "", route("website", b, site,
                              "their own site — usually has a contact page")),
        F.when(e != "", route("email", e, F.concat(F.lit("mailto:"), e),
                              "published on their GitHub profile, which is hidden by "
                              "default")),
        F.when(t != "", route("x", F.concat(F.lit("@"), t),
                              F.concat(F.lit("https://x.com/"), t), "public handle"))))


def allowed_routes(routes: Column | str) -> Column:
    """First ten routes, those with a plain link scheme, cut to their field widths."""
    def is_allowed(r):
        link = F.lower(strip(r["url"]))
        return functools.reduce(lambda a, b: a | b,
                                [link.startswith(s) for s in rules.ROUTE_SCHEMES])

    def cut(r):
        return F.struct(F.substring(blank(r["kind"]), 1, 20).alias("kind"),
                        F.substring(blank(r["value"]), 1, 200).alias("value"),
                        F.substring(strip(r["url"]), 1, 500).alias("url"),
                        F.substring(blank(r["note"]), 1, 200).alias("note"))
    return F.transform(F.filter(F.slice(col(routes), 1, 10), is_allowed), cut)


def person_score(signals="signals", relationship="relationship", routes="routes") -> Column:
    return signal_weight(signals) \
        + F.when(blank(relationship) == "member", rules.MEMBER_POINTS).otherwise(0) \
        + F.when(F.size(col(routes)) > 0, rules.REACHABLE_POINTS).otherwise(0)


def org_slugs(company: Column | str) -> Column:
    """Ordered candidate organisation slugs; a slug that is not valid is dropped."""
    key = F.lower(strip(company))
    alnum = r"(?U)[^\p{L}\p{N}]"
    flat = F.regexp_replace(key, alnum, "")
    words = F.transform(F.split(F.regexp_replace(key, r"(?U)[\s\x1c-\x1f]+", " "), " "),
                        lambda w: F.regexp_replace(w, alnum, ""))
    dashed = F.trim(F.array_join(words, "-"), F.lit("-"))
    tried = F.when(flat != "", F.array(flat, dashed, F.concat(flat, F.lit("hq")),
                                       F.concat(flat, F.lit("-oss")))) \
        .otherwise(F.array(flat, dashed))
    valid = F.filter(F.array_distinct(tried), lambda s: s.rlike(rules.ORG_SLUG_PATTERN))
    known = F.create_map(*[F.lit(x) for kv in rules.ORG_OVERRIDES.items() for x in kv])
    override = F.try_element_at(known, key)
    return F.when(override.isNotNull(), F.array(override)).otherwise(valid)


def search_links(company: Column | str, role: Column | str | None = None) -> Column:
    """array<struct(kind, key, url)> of prepared searches for one employer."""
    name = strip(company)

    def link(kind, key, base, query):
        return F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"),
                        F.concat(F.lit(base), url_quote_plus(query)).alias("url"))

    links = [link("people", key, rules.PEOPLE_SEARCH_URL,
                  F.concat_ws(" ", name, F.lit(term)))
             for key, term in rules.PEOPLE_SEARCH_TERMS]
    profile = F.concat(F.lit('site:linkedin.com/in/ "'), name, F.lit('"'))
    tail = F.lit("-inurl:dir")
    for key, term in rules.XRAY_TERMS:
        links.append(link("web", key, rules.WEB_SEARCH_URL,
                          F.concat_ws(" ", profile, F.lit(f'"{term}"'), tail)))
    if role is not None:
        quoted = F.concat(F.lit('"'), strip(role), F.lit('"'))
        links.append(F.when(strip(role) != "",
                            link("web", "xray-role", rules.WEB_SEARCH_URL,
                                 F.concat_ws(" ", profile, quoted, tail))))
    links.append(link("web", "xray-hiring-manager", rules.WEB_SEARCH_URL,
                      F.concat_ws(" ", profile, F.lit(rules.XRAY_MANAGERS),
                                  F.lit('"London"'), tail)))
    links.append(link("web", "xray-github", rules.WEB_SEARCH_URL,
                      F.concat(F.lit('site:github.com "'), name, F.lit('" "London"'))))
    built = F.array_compact(F.array(*links))
    return F.when(name != "", built).otherwise(F.filter(built, lambda _: F.lit(False)))


def role_question(title: Column | str) -> Column:
    """The question for the first rule whose needle the title contains."""
    low = F.lower(blank(title))
    chain = F
    for needles, question in rules.ROLE_QUESTIONS:
        found = functools.reduce(lambda a, b: a | b, [low.contains(n) for n in needles])
        chain = chain.when(found, question)
    return chain.otherwise(rules.DEFAULT_QUESTION)


def opening_key(signals: Column | str) -> Column:
    """The first key of the priority list present in the signal array, else ''."""
    present = F.array_intersect(_strings(rules.HOOK_PRIORITY), col(signals))
    return F.coalesce(F.try_element_at(present, F.lit(1)), F.lit(""))


def first_fit(*candidates: Column, limit: int = rules.NOTE_LIMIT) -> Column:
    """The first tidied candidate that fits the limit, the last one otherwise."""
    texts = [tidy(c) for c in candidates]
    return F.coalesce(*[F.when(F.length(t) <= limit, t) for t in texts], texts[-1])


def lint_warnings(text: Column | str, extra: list[tuple[str, str]] = ()) -> Column:
    """Warnings for a drafted text: asking phrases, the dash pause, and any extra
    (pattern, message) rules the caller brings."""
    low = F.lower(blank(text))
    found = []
    for pattern in rules.ASK_PATTERNS:
        hit = F.regexp_extract(low, "(?U)" + pattern, 0)
        found.append(F.when(low.rlike("(?U)" + pattern), F.concat(
            F.lit("asks for a referral ('"), hit,
            F.lit("') — the first message should ask a question instead"))))
    found.append(F.when(blank(text).contains("—") | blank(text).contains(" -- "),
                        F.lit("em dash used as a pause")))
    for pattern, message in extra:
        found.append(F.when(has(text, pattern), F.lit(message)))
    return F.array_compact(F.array(*found))
