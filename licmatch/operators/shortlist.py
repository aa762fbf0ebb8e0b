"""Daily shortlist and apply shortlist."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from licmatch import rules
from licmatch.functions import gates
from licmatch.functions.text import as_int, blank, normalise, twin_key
from licmatch.operators.frames import first_per_key

CUT_REASON = "previously CUT (see decisions.json)"
AGENCY_REASON = "agency listing"
DELISTED_REASON = "delisted (410 Gone)"
DUPLICATE_REASON = "duplicate listing"


def normal_rulings(rulings: DataFrame) -> DataFrame:
    """Rulings by what they look for: a company part and, for a role, a title part."""
    is_role = F.col("kind") == "role"
    mark = F.instr("ruling_key", "::")
    company = F.when(is_role & (mark > 0), F.substring_index("ruling_key", "::", 1)) \
        .otherwise(F.col("ruling_key"))
    title = F.when(is_role & (mark > 0), F.substr("ruling_key", mark + 2)).otherwise("")
    keyed = rulings.select(
        normalise(company).alias("company_part"), normalise(title).alias("title_part"),
        F.when(is_role, 0).otherwise(1).alias("rank"), F.col("ord").alias("ruling_ord"),
        "verdict", "reason", "verified")
    return first_per_key(keyed, ["company_part", "title_part", "rank"], ["ruling_ord"])


_TITLE_SHIFT = 1_000_000
#: Longs of a sketch of ruling parts, whatever their number: 2 MB.
_SKETCH_LONGS = 2 ** 18
_PROBES = 2
#: Characters a longer ruling part begins with, which are looked up before its lengths are tried.
_HEAD = 6


def _bits(part: Column, kind: str = "part") -> list[Column]:
    """The bits of a part, or of a head, in a sketch."""
    return [F.pmod(F.xxhash64(part, F.lit(f"{kind}{k}")), F.lit(_SKETCH_LONGS * 64))
            for k in range(_PROBES)]


def _sketch(parts: Column, known: DataFrame) -> Column:
    """Bit set of the parts and their heads as an array of longs: what is not in it is unknown."""
    marks = known.select(F.explode(F.array(
        *_bits(parts), *_bits(F.substring(parts, 1, _HEAD), "head"))).alias("bit")).distinct().select(
        F.expr("bit div 64").alias("at"),
        F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits"))
    empty = known.sparkSession.range(_SKETCH_LONGS).select(
        F.col("id").alias("at"), F.lit(0).cast("bigint").alias("bits"))
    return marks.union(empty).groupBy("at").agg(F.bit_or("bits").alias("bits")).select(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))),
                    lambda x: x["bits"])).scalar()


def _with_parts(texts: DataFrame, text: str, lengths: Column, sketch: Column,
                part: str) -> DataFrame:
    """A row per substring of ``text`` that may be among the ruling parts: its length occurs there
    and it and its head are in the ``sketch``. A substring may come twice.

    Containment becomes an equi join on ``part``: only true matches come out of it and
    nothing is compared pairwise.
    """
    if part == "title_part":
        wanted = F.transform(F.filter("_lengths", lambda n: n >= _TITLE_SHIFT),
                             lambda n: n - _TITLE_SHIFT)
    else:
        wanted = F.filter("_lengths", lambda n: n < _TITLE_SHIFT)

    def maybe(piece: Column, kind: str = "part") -> Column:
        marked = [F.getbit(F.get(sketch, F.shiftright(bit, 6).cast("int")),
                           bit.bitwiseAND(63).cast("int")) == 1 for bit in _bits(piece, kind)]
        return marked[0] & marked[1]
    begins = texts.select(
        text, F.explode(F.sequence(F.lit(1), F.length(text) + 1)).alias("_at")) \
        .withColumn("_head", maybe(F.substring(F.col(text), F.col("_at"), F.lit(_HEAD)),
                                   "head")) \
        .withColumn("_lengths", lengths).withColumn("_lengths", wanted)
    left = F.length(text) - F.col("_at") + 1
    sizes = F.filter("_lengths", lambda n: (n <= left) & (F.col("_head") | (n < _HEAD))
                     & ((n > 0) | (F.col("_at") == 1)))
    return begins.withColumn("_size", F.explode(sizes)) \
        .select(text, F.substring(F.col(text), F.col("_at"), F.col("_size")).alias(part)) \
        .filter(maybe(F.col(part)))


def attach_rulings(rows: DataFrame, rulings: DataFrame,
                   subjects: DataFrame | None = None) -> DataFrame:
    """Most specific prior ruling per row: role before company, file order, first wins.

    A ruling matches by containment; an empty half of a ruling key matches everything.
    Companies and titles are expanded once per distinct name, and only the parts they really
    contain meet in a (company, title) pair.
    ``subjects`` may name a cheaper frame that holds every company and title of ``rows``,
    such as the raw postings; only those two columns of it are read.
    """
    known = normal_rulings(rulings)
    # Lengths that occur, title lengths shifted: one small scalar serves both expansions.
    lengths = known.select(F.explode(F.array(
        F.length("company_part"), F.length("title_part") + _TITLE_SHIFT)).alias("n")) \
        .select(F.collect_set("n")).scalar()
    pairs = (rows if subjects is None else subjects).select(
        normalise("company").alias("_company"), normalise("title").alias("_title")) \
        .distinct()

    def containing(text: str, part: str) -> DataFrame:
        return _with_parts(pairs.select(text).distinct(), text, lengths,
                           _sketch(F.col(part), known), part) \
            .join(known.select(part), part, "left_semi").distinct()
    found = pairs.join(containing("_company", "company_part"), "_company") \
        .join(containing("_title", "title_part"), "_title") \
        .join(known, ["company_part", "title_part"])
    first = first_per_key(
        found.select("_company", "_title", "rank", "ruling_ord", "verdict", "reason",
                     "verified"), ["_company", "_title"], ["rank", "ruling_ord"])
    keyed = rows.withColumn("_company", normalise("company")) \
        .withColumn("_title", normalise("title"))
    return keyed.join(first.select(
        "_company", "_title", F.col("verdict").alias("ruling_verdict"),
        F.col("reason").alias("ruling_reason"),
        F.col("verified").alias("ruling_verified")), ["_company", "_title"], "left") \
        .select(*rows.columns, "ruling_verdict", "ruling_reason", "ruling_verified")


def first_listings(rows: DataFrame, order: str = "ord") -> DataFrame:
    """First listing per (title, company) key."""
    keyed = rows.withColumn("_t", normalise("title")).withColumn("_c", normalise("company"))
    return first_per_key(keyed, ["_t", "_c"], [order]).drop("_t", "_c")


def gated(rows: DataFrame, rulings: DataFrame | None, as_of, max_age: int | None = 30,
          include_agency: bool = False, closures: DataFrame | None = None,
          subjects: DataFrame | None = None) -> DataFrame:
    """Rows with a ``drop_reason`` (null = still in), before duplicates are counted."""
    judged = rows.withColumn("_gate", gates.disqualify(as_of, max_age))
    if closures is not None:
        closed = closures.select("id").distinct().withColumn("_closed", F.lit(True))
        judged = judged.join(closed, "id", "left").withColumn("_gate", F.coalesce(
            "_gate", F.when(F.col("_closed"), "closed on its board"))).drop("_closed")
    if rulings is None:
        ruled = judged.withColumns({n: F.lit(None).cast("string") for n in (
            "ruling_verdict", "ruling_reason", "ruling_verified")})
    else:
        ruled = attach_rulings(judged, rulings, subjects)
    reason = F.coalesce(
        F.col("_gate"), F.when(F.col("ruling_verdict") == "CUT", CUT_REASON),
        F.lit(None) if include_agency else F.when(gates.is_agency(), AGENCY_REASON))
    return ruled.withColumn("drop_reason", reason).drop("_gate")


def survivors(rows: DataFrame, rulings: DataFrame | None, as_of, max_age: int | None = 30,
              include_agency: bool = False, closures: DataFrame | None = None,
              subjects: DataFrame | None = None) -> DataFrame:
    """The candidates: gated, one row per (title, company), prior CUTs removed.

    A ruling depends on the duplicate key alone, so duplicates go first: the ruling join
    then sees every key once, whatever the number of relistings.
    """
    kept = rows.filter(gates.disqualify(as_of, max_age).isNull())
    if not include_agency:
        kept = kept.filter(~gates.is_agency())
    if closures is not None:
        kept = kept.join(closures.select("id"), "id", "left_anti")
    kept = first_listings(kept)
    if rulings is None:
        return kept.withColumns({n: F.lit(None).cast("string") for n in (
            "ruling_verdict", "ruling_reason", "ruling_verified")})
    return attach_rulings(kept, rulings, subjects) \
        .filter(~F.col("ruling_verdict").eqNullSafe(F.lit("CUT")))


def age_limit(max_age: int | None, verified: bool) -> int | None:
    """The age gate in force: age is a guess, so it stands down when liveness is checked,
    unless it was asked for; 0 turns it off."""
    if max_age is None:
        return None if verified else rules.DEFAULT_MAX_AGE
    return max_age if max_age > 0 else None


def scored(rows: DataFrame, as_of) -> DataFrame:
    return rows.withColumn("score", gates.score(as_of)) \
        .withColumn("reasons", gates.score_reasons(as_of))


def attach_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Liveness by id: dead rows go, unknown ones are flagged.

    A posting from an employer board is never probed, so it carries no flag.
    """
    known = verdicts.select("id", F.col("verdict").alias("_verdict"))
    probed = F.coalesce("source", F.lit(rules.AGGREGATOR_SOURCE)) == rules.AGGREGATOR_SOURCE
    state = F.when(probed, F.when(F.col("id").contains(":"), "unknown")
                   .otherwise(F.coalesce("_verdict", F.lit("unknown"))))
    return rows.join(known, "id", "left").withColumn("liveness", state) \
        .filter(~F.col("liveness").eqNullSafe(F.lit("dead"))).drop("_verdict")


def daily_shortlist(rows: DataFrame, rulings: DataFrame | None, as_of, top: int = 10,
                    max_age: int | None = None, include_agency: bool = False,
                    verdicts: DataFrame | None = None,
                    closures: DataFrame | None = None,
                    subjects: DataFrame | None = None) -> DataFrame:
    """Ranked candidates of the day: gate, rulings, first listing, score, top N.

    With ``verdicts`` dead postings go before the top N is taken, so N are left while there
    are N.
    """
    limit = age_limit(max_age, verdicts is not None)
    kept = survivors(rows, rulings, as_of, limit, include_agency, closures, subjects)
    ranked = scored(kept, as_of)
    order = [F.desc("score"), F.asc("ord")]
    if verdicts is not None:
        ranked = attach_verdicts(ranked, verdicts)
    return ranked.orderBy(*order).limit(top)


def drop_histogram(rows: DataFrame, rulings: DataFrame | None, as_of,
                   max_age: int | None = 30, include_agency: bool = False,
                   subjects: DataFrame | None = None, closures: DataFrame | None = None,
                   verdicts: DataFrame | None = None) -> DataFrame:
    """(reason, rows): why rows are not candidates, duplicates included.

    With ``closures`` rows their boards no longer list count as such, and with ``verdicts`` (id,
    verdict) the candidates that turned out dead as delisted.
    """
    judged = gated(rows, rulings, as_of, max_age, include_agency, closures, subjects)
    # One pass: rows still in are counted per duplicate key, all but one of a key repeat.
    still_in = F.col("drop_reason").isNull()
    keyed = judged.groupBy(
        "drop_reason", F.when(still_in, normalise("title")).alias("_t"),
        F.when(still_in, normalise("company")).alias("_c")).agg(
            F.count(F.lit(1)).alias("n"), F.min_by("id", "ord").alias("id"))
    known = keyed if verdicts is None else attach_verdict(keyed, verdicts, still_in)
    dead = F.lit(0) if verdicts is None else F.when(
        F.col("_dead"), F.lit(1)).otherwise(F.lit(0))
    counted = known.select(
        F.explode(F.array(
            F.struct(F.coalesce("drop_reason", F.lit(DUPLICATE_REASON)).alias("reason"),
                     F.when(still_in, F.col("n") - 1).otherwise(F.col("n")).alias("rows")),
            F.struct(F.lit(DELISTED_REASON).alias("reason"),
                     dead.cast("bigint").alias("rows")))).alias("drop")).select("drop.*")
    return counted.groupBy("reason").agg(F.sum("rows").alias("rows")).filter(F.col("rows") > 0)


def attach_verdict(keyed: DataFrame, verdicts: DataFrame, candidate: Column) -> DataFrame:
    """Mark candidates from the aggregator that have a dead verdict."""
    dead = verdicts.filter(F.col("verdict") == "dead").select("id").distinct() \
        .withColumn("_mark", F.lit(True))
    return keyed.join(dead, "id", "left").withColumn(
        "_dead", candidate & F.col("_mark") & ~F.col("id").contains(":"))


# --- apply shortlist --------------------------------------------------------------------

def _london_then_salary() -> list:
    return [F.when(gates.is_london(), 0).otherwise(1).alias("_london"),
            (-as_int("salary_max")).alias("_salary")]


def best_twins(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Best row per repost key, with the order position of the key's first row.

    One map-side combined minimum of (london, salary, order, row) per key; no window over
    the group, so a hot key is reduced before it is shuffled.
    """
    london, salary = _london_then_salary()
    packed = F.struct(london, salary, F.col(order).alias("_ord"),
                      F.struct(*rows.columns).alias("row"))
    return rows.groupBy(twin_key("company").alias("twin_company"),
                        twin_key("title").alias("twin_title")) \
        .agg(F.min(packed).alias("best"), F.min(order).alias("first_ord")) \
        .select("best.row.*", "first_ord")


def apply_shortlist(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Apply-ready rows, one per repost key, London first and then by salary."""
    ready = rows.filter(gates.apply_ready_reason().isNull())
    london, salary = _london_then_salary()
    return best_twins(ready, order).orderBy(london, salary, "first_ord")


def store_keys(order: str = "ord") -> list[Column]:
    """Confirmed first, then London, then salary."""
    london, salary = _london_then_salary()
    return [F.when(blank("sponsor_match") == "yes", 0).otherwise(1), london, salary,
            F.col(order)]


def store_order(rows: DataFrame, order: str = "ord") -> DataFrame:
    return rows.orderBy(*store_keys(order))


def top_by_salary(rows: DataFrame, n: int = 5, order: str = "ord") -> DataFrame:
    return rows.orderBy(-as_int("salary_max"), order).limit(n)
