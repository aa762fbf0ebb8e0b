"""Name, id, number and markup functions. Column in, Column out; blank means ''."""
from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from licmatch import rules

# Everything str.isspace() accepts, as an argument for trim.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
NATIVE_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
                   ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"),
                   ("&copy;", "©"), ("&amp;", "&")]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim every kind of whitespace; a text with ordinary ends is passed through."""
    value = blank(c)
    ends = [F.ascii(value), F.ascii(F.substring(value, -1, 1))]
    plain = ends[0].between(33, 132) & ends[1].between(33, 132)
    return F.when(plain, value).otherwise(F.trim(value, F.lit(WHITESPACE)))


def or_else(*cols: Column | str) -> Column:
    """The first non-blank value, '' when there is none."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols], F.lit(""))


def has(c: Column | str, pattern: str) -> Column:
    return blank(c).rlike(rules.FLAGS + pattern)


def normalize_name(name: Column | str) -> Column:
    """Register key of an organisation name: letters and digits, no THE, no legal tail."""
    text = F.regexp_replace(F.replace(F.upper(blank(name)), F.lit("&"), F.lit(" AND ")),
                            "[^A-Z0-9]+", " ")
    text = F.regexp_replace(F.trim(text), "^THE ", "")
    suffixes = "|".join(rules.LEGAL_SUFFIXES)
    return F.regexp_replace(text, f"(?:(?:^| )(?:{suffixes}))+$", "")


def parse_rating(type_and_rating: Column | str) -> Column:
    return F.upper(F.regexp_extract(blank(type_and_rating),
                                    rules.FLAGS + rules.RATING_PATTERN, 1))


def normalise(text: Column | str) -> Column:
    """Ruling and duplicate key: punctuation becomes one space."""
    return F.trim(F.regexp_replace(F.lower(blank(text)), "[^a-z0-9]+", " "))


def twin_key(text: Column | str) -> Column:
    """Repost key: punctuation is deleted, so is every legal-form word."""
    kept = F.regexp_replace(F.lower(blank(text)), "[^a-z0-9 ]", "")
    words = "|".join(rules.TWIN_KEY_WORDS)
    return F.trim(F.regexp_replace(kept, rf"\b({words})\b", ""))


def source_of(job_id: Column | str) -> Column:
    jid = blank(job_id)
    return F.when(jid.contains(":"), F.substring_index(jid, ":", 1)) \
        .otherwise(F.lit(rules.AGGREGATOR_SOURCE))


def clean_id(job_id: Column | str) -> Column:
    """A numeric id that went through a spreadsheet comes back as '123.0'."""
    return F.regexp_replace(blank(job_id), r"\.0$", "")


def as_int(value: Column | str) -> Column:
    """Whole part of a number written as text or stored as one; anything else is 0."""
    number = F.expr(f"try_cast({value} AS DOUBLE)") if isinstance(value, str) \
        else value.try_cast("double")
    finite = F.when(F.isnan(number) | (F.abs(number) == F.lit(float("inf"))), F.lit(0.0)) \
        .otherwise(number)
    return F.coalesce(finite.try_cast("bigint"), F.lit(0).cast("bigint"))


def contract_type(value: Column | str) -> Column:
    key = F.replace(F.lower(strip(value)), F.lit(" "), F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in rules.CONTRACT_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(""))


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decode_entities(text: Column | str, exact: bool = True) -> Column:
    """HTML entity decode.

    The exact form knows every named and numeric entity; only texts that hold an ampersand
    cross to Python. ``exact=False`` decodes the common entities inside the JVM.
    """
    value = col(text)
    if exact:
        return F.coalesce(_unescape(F.when(value.contains("&"), value)), value)
    for entity, char in NATIVE_ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def clean_snippet(text: Column | str, exact: bool = True) -> Column:
    """Tags out, entities decoded, whitespace collapsed."""
    stripped = F.regexp_replace(blank(text), "<[^>]+>", " ")
    return strip(F.regexp_replace(decode_entities(stripped, exact), SPACE_RUN, " "))


def clean_html(text: Column | str, exact: bool = True) -> Column:
    """For entity-encoded markup: decode first, then clean as a snippet."""
    return clean_snippet(decode_entities(blank(text), exact), exact)


def slug(text: Column | str) -> Column:
    dashed = F.regexp_replace(F.lower(blank(text)), "[^a-z0-9]+", "-")
    return F.substring(F.trim(dashed, F.lit("-")), 1, 60)


def tidy(text: Column | str) -> Column:
    return strip(F.regexp_replace(blank(text), "[ \t]+", " "))


def append_note(existing: Column | str, note: Column | str, on: Column) -> Column:
    """`existing` plus a dated line; a blank note changes nothing."""
    line = F.concat(on.cast("string"), F.lit(": "), strip(note))
    return F.when(strip(note) == "", blank(existing)) \
        .when(strip(existing) == "", line) \
        .otherwise(strip(F.concat(strip(existing), F.lit("\n"), line)))


def url_quote_plus(text: Column | str) -> Column:
    """Query-string encoding with + for a space, * encoded and ~ left alone."""
    return F.replace(F.replace(F.url_encode(blank(text)), F.lit("*"), F.lit("%2A")),
                     F.lit("%7E"), F.lit("~"))


def first_name(name: Column | str) -> Column:
    """The given name when it looks like one, else ''."""
    part = F.substring_index(strip(name), " ", 1)
    return F.when(part.rlike(r"(?U)^[\p{L}\p{N}&&[^\p{Nd}]]+"
                             r"(?:['-][\p{L}\p{N}&&[^\p{Nd}]]+)*$"), part) \
        .otherwise(F.lit(""))
