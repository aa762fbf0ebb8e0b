"""Licence lookup, matching and suggestions.

Suggestions are equi joins. A register key is expanded into its word prefixes (and into the
word prefixes of its trading names), and a company key either equals one of them or does not
match: no candidate pair is ever produced that has to be thrown away.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from licmatch import rules
from licmatch.functions.text import blank, col, normalize_name, parse_rating, strip
from licmatch.operators.frames import first_per_key

_CODES = ["A", "B", ""]


def licence_lookup(register: DataFrame, org="org", type_rating="type_rating",
                   route="route", order="ord") -> DataFrame:
    """(key, rating, ord): one row per Skilled Worker key.

    'A' wins, otherwise the first-seen rating stays. The first-seen rating rides in the low
    digits of the order value, so both come from one map-side combined minimum.
    """
    code = F.array_position(F.array(*[F.lit(c) for c in _CODES]), parse_rating(type_rating))
    rows = register.filter(strip(route) == rules.SKILLED_WORKER_ROUTE) \
        .select(normalize_name(org).alias("key"), col(order).alias("ord"),
                (code - 1).alias("code")) \
        .filter(F.col("key") != "")
    folded = rows.groupBy("key").agg(
        F.min(F.col("ord") * 4 + F.col("code")).alias("packed"),
        F.max(F.col("code") == 0).alias("has_a"))
    rating = F.when(F.col("has_a"), "A") \
        .otherwise(F.element_at(F.array(*[F.lit(c) for c in _CODES]),
                                (F.pmod(F.col("packed"), F.lit(4)) + 1).cast("int")))
    return folded.select("key", rating.alias("rating"),
                         F.expr("packed div 4").alias("ord"))


def alias_keys(aliases: DataFrame) -> DataFrame:
    """The alias overlay by normalised company; a later entry of the same key wins."""
    keyed = aliases.withColumn("key", normalize_name("company"))
    fields = [c for c in keyed.columns if c not in ("key", "company", "ord")]
    return keyed.groupBy("key").agg(*[F.max_by(c, "ord").alias(c) for c in fields]) \
        .filter(F.col("key") != "")


def effective_lookup(lookup: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, rating) with the confirmed aliases laid over the register.

    Folding the overlay in first leaves one join for the large posting side.
    """
    base = lookup.select("key", "rating")
    if aliases is None:
        return base
    overlay = alias_keys(aliases).select(
        "key", normalize_name("register_name").alias("register_key"),
        F.col("rating").alias("alias_rating"))
    # The few register entries that the overlay names, so the register is never shuffled by it.
    named = overlay.select("key").union(overlay.select("register_key")).distinct()
    found = base.join(named, "key", "left_semi")
    register = found.select(F.col("key").alias("register_key"),
                            F.col("rating").alias("register_rating"))
    confirmed = overlay.join(register, "register_key", "left") \
        .select("key", F.coalesce("register_rating", blank("alias_rating")).alias("over"))
    laid = base.join(confirmed, "key", "left") \
        .select("key", F.coalesce("over", "rating").alias("rating"))
    added = confirmed.join(found.select("key"), "key", "left_anti") \
        .select("key", F.col("over").alias("rating"))
    return laid.unionByName(added)


def match_companies(rows: DataFrame, lookup: DataFrame | None,
                    aliases: DataFrame | None = None,
                    company: Column | str = "company") -> DataFrame:
    """Stamp sponsor_match, sponsor_rating and sponsor_route; never drops a row.

    ``lookup=None`` means the register is unavailable: everything is unconfirmed.
    """
    rest = [c for c in rows.columns
            if c not in ("sponsor_match", "sponsor_rating", "sponsor_route")]
    if lookup is None:
        return rows.select(*rest, F.lit("unconfirmed").alias("sponsor_match"),
                           F.lit("").alias("sponsor_rating"),
                           F.lit("").alias("sponsor_route")).select(*_order(rows))
    known = effective_lookup(lookup, aliases) \
        .select(F.col("key").alias("_key"), F.col("rating").alias("_rating"))
    joined = rows.select(*rest, F.nullif(normalize_name(company), F.lit("")).alias("_key")) \
        .join(known, "_key", "left")
    hit = F.col("_rating").isNotNull()
    return joined.select(
        *rest,
        F.when(F.col("_key").isNull(), "unconfirmed").when(hit, "yes").otherwise("no")
        .alias("sponsor_match"),
        F.coalesce("_rating", F.lit("")).alias("sponsor_rating"),
        F.when(hit, rules.SKILLED_WORKER_ROUTE).otherwise("").alias("sponsor_route")) \
        .select(*_order(rows))


def _order(rows: DataFrame) -> list[str]:
    extra = [c for c in ("sponsor_match", "sponsor_rating", "sponsor_route")
             if c not in rows.columns]
    return [*rows.columns, *extra]


def match_board_rows(rows: DataFrame, boards: DataFrame, lookup: DataFrame,
                     aliases: DataFrame | None = None) -> DataFrame:
    """Match a feed posting by its board's register name when it has one.

    Boards are told apart by family and slug where the rows carry their board's ``slug`` (which
    goes), else by family and company.
    """
    mine = ["source", "slug"] if "slug" in rows.columns and "slug" in boards.columns \
        else ["source", "company"]
    prefixes = F.create_map(*[F.lit(x) for kv in rules.FAMILY_PREFIXES.items() for x in kv])
    named = boards.filter(strip("register_name") != "").select(
        mine[1], F.coalesce(F.try_element_at(prefixes, F.col("ats")), F.col("ats"))
        .alias("source"), strip("register_name").alias("_register_name"), "ord")
    names = first_per_key(named, mine, ["ord"]).drop("ord")
    joined = rows.join(names, mine, "left").select(
        *[c for c in rows.columns if c not in mine[1:] or c == "company"], "_register_name")
    return match_companies(joined, lookup, aliases,
                           F.coalesce("_register_name", "company")).drop("_register_name")


def board_register_names(boards: DataFrame) -> DataFrame:
    """(key, register_name) from the board registry, last row of a key wins."""
    return boards.filter((strip("company") != "") & (strip("register_name") != "")) \
        .groupBy(normalize_name("company").alias("key")) \
        .agg(F.max_by(strip("register_name"), "ord").alias("register_name"))


def resolutions(lookup: DataFrame, aliases: DataFrame, boards: DataFrame) -> DataFrame:
    """key -> how it resolves and on whose authority: alias, then board, then exact."""
    blank_text = F.lit("")
    by_alias = alias_keys(aliases).select(
        "key", F.lit("alias").alias("method"), blank("register_name").alias("register_name"),
        blank("rating").alias("rating"), blank("actor").alias("confirmed_by"),
        blank("confirmed").alias("confirmed_at"), blank("rationale").alias("rationale"))
    boarded = board_register_names(boards) \
        .withColumn("register_key", normalize_name("register_name"))
    rated = lookup.select(F.col("key").alias("register_key"), "rating")
    by_board = boarded.join(rated, "register_key", "left").select(
        "key", F.lit("board").alias("method"), "register_name",
        blank("rating").alias("rating"), blank_text.alias("confirmed_by"),
        blank_text.alias("confirmed_at"),
        F.lit("mapped in the board registry when this employer's job board was added")
        .alias("rationale"))
    by_board = by_board.join(by_alias.select("key"), "key", "left_anti")
    overlay = by_alias.unionByName(by_board)
    exact = lookup.join(overlay.select("key"), "key", "left_anti").select(
        "key", F.lit("exact").alias("method"), F.col("key").alias("register_name"), "rating",
        blank_text.alias("confirmed_by"), blank_text.alias("confirmed_at"),
        blank_text.alias("rationale"))
    return overlay.unionByName(exact)


def resolve(rows: DataFrame, lookup: DataFrame, aliases: DataFrame, boards: DataFrame,
            company: str = "company") -> DataFrame:
    """Attach a ``resolution`` struct to every row; method 'none' when nothing matches."""
    fields = ["method", "register_name", "rating", "confirmed_by", "confirmed_at",
              "rationale"]
    known = resolutions(lookup, aliases, boards) \
        .select(F.col("key").alias("_key"), F.struct(*fields).alias("resolution"))
    none = F.struct(F.lit("none").alias("method"), *[F.lit("").alias(f) for f in fields[1:]])
    return rows.withColumn("_key", normalize_name(company)).join(known, "_key", "left") \
        .withColumn("resolution", F.coalesce("resolution", none)).drop("_key")


def register_entry(names: DataFrame, lookup: DataFrame, name: str) -> DataFrame:
    """Is this name a licensed entry, and with which rating ('' when it is not)."""
    known = lookup.select(F.col("key").alias("_key"), F.col("rating").alias("_rating"))
    return names.withColumn("_key", normalize_name(name)).join(known, "_key", "left") \
        .withColumn("has_entry", F.col("_rating").isNotNull()) \
        .withColumn("rating", blank("_rating")).drop("_key", "_rating")


# --- suggestions ------------------------------------------------------------------------

def _word_prefixes(words: Column, count: Column) -> Column:
    """Word prefixes of an array holding 1 .. count words; empty when count < 1."""
    return F.when(count >= 1, F.transform(
        F.sequence(F.lit(1), count), lambda n: F.array_join(F.slice(words, 1, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


def trade_token(key: Column | str) -> Column:
    """First word after the first ' T A ' of a key, '' when it has no trading name."""
    key = col(key)
    at = F.instr(key, " T A ")
    tail = F.when(at > 0, F.substr(key, at + 5))
    return blank(F.substring_index(tail, " ", 1))


def suggestion_prefixes(lookup: DataFrame) -> DataFrame:
    """(prefix, rule, candidate, rating, ord): every company key each entry answers to.

    rule 0 is a word prefix of the entry itself, rule 1 a word prefix of a trading name
    that starts with the same word as the entry's first trading name.
    """
    words = F.split("key", " ")
    size = F.size(words)
    own = _word_prefixes(words, size - 1)
    marks = F.when(size >= 3, F.filter(
        F.sequence(F.lit(1), size - 2),
        lambda i: (F.element_at(words, i) == "T") & (F.element_at(words, i + 1) == "A"))) \
        .otherwise(F.array().cast("array<int>"))
    token = trade_token("key")
    trading = F.flatten(F.transform(marks, lambda i: _word_prefixes(
        F.slice(words, i + 2, size), size - i - 1)))
    trading = F.filter(F.array_distinct(trading),
                       lambda p: (token != "") & (F.substring_index(p, " ", 1) == token))

    def tagged(prefixes: Column, rule: int) -> Column:
        long_enough = F.filter(prefixes,
                               lambda p: F.length(p) >= rules.MIN_SUGGESTION_KEY)
        return F.transform(long_enough, lambda p: F.struct(p.alias("prefix"),
                                                           F.lit(rule).alias("rule")))
    return lookup.select(F.inline(F.concat(tagged(own, 0), tagged(trading, 1))),
                         F.col("key").alias("candidate"), "rating", "ord")


def open_keys(companies: DataFrame, lookup: DataFrame, company="company") -> DataFrame:
    """Distinct company keys worth a suggestion: long enough and not an exact hit."""
    keys = companies.select(normalize_name(company).alias("key")).distinct() \
        .filter(F.length("key") >= rules.MIN_SUGGESTION_KEY)
    return keys.join(lookup.select("key"), "key", "left_anti")


def candidates(keys: DataFrame, lookup: DataFrame) -> DataFrame:
    """All (key, rule, candidate) matches of company keys against the register."""
    return keys.join(suggestion_prefixes(lookup)
                     .withColumnRenamed("prefix", "key"), "key")


def suggest(keys: DataFrame, lookup: DataFrame,
            limit: int = rules.SUGGESTION_LIMIT) -> DataFrame:
    """Top suggestions per company key: prefix matches first, in register order.

    The limit is applied per (prefix, rule) below the join already, which is exact because
    every company with that key ranks the same candidates in the same order.
    """
    best = first_per_key(suggestion_prefixes(lookup), ["prefix", "rule"], ["ord"], limit)
    joined = keys.join(best.withColumnRenamed("prefix", "key"), "key")
    top = first_per_key(joined, ["key"], ["rule", "ord"], limit)
    return top.withColumn("why", F.when(F.col("rule") == 0, "prefix")
                          .otherwise("trading-as"))


def without_rejected(suggestions: DataFrame, rejections: DataFrame) -> DataFrame:
    """Drop suggestions a person has already turned down for that company."""
    return suggestions.join(
        rejections.select("key", F.col("register_name").alias("candidate")),
        ["key", "candidate"], "left_anti")


def flag_rejected(suggestions: DataFrame, rejections: DataFrame) -> DataFrame:
    turned_down = rejections.select("key", F.col("register_name").alias("candidate")) \
        .distinct().withColumn("rejected", F.lit(True))
    return suggestions.join(turned_down, ["key", "candidate"], "left") \
        .withColumn("rejected", F.coalesce("rejected", F.lit(False)))


def token_blocks(lookup: DataFrame) -> DataFrame:
    """(rule, token, entries): how many register keys share a first or trading word."""
    first = lookup.select(F.lit("first").alias("rule"),
                          F.substring_index("key", " ", 1).alias("token"))
    trade = lookup.select(F.lit("trade").alias("rule"), trade_token("key").alias("token")) \
        .filter(F.col("token") != "")
    return first.unionByName(trade).groupBy("rule", "token") \
        .agg(F.count(F.lit(1)).alias("entries"))


def register_search(lookup: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Register entries for a typed name: prefix hits if there are enough, else any hit."""
    q = normalize_name(F.lit(query))
    asked = lookup.filter(F.length(q) >= 2)
    same_word = F.substring_index("key", " ", 1) == F.substring_index(q, " ", 1)
    prefix_hit = same_word & F.col("key").startswith(q)
    enough = asked.filter(prefix_hit).select(F.count(F.lit(1)) >= limit).scalar()
    hits = asked.filter(F.when(enough, prefix_hit).otherwise(F.contains("key", q)))
    return hits.select(F.col("key").alias("register_name"), "rating") \
        .orderBy("register_name", "rating").limit(limit)
