"""Date reading. No function here depends on the session time zone or on the clock."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from licmatch.functions.text import blank, col, strip

_ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:(?:T| +)(\d{1,2}):(\d{1,2}):(\d{1,2})Z?)?$"
_DMY = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
           "September", "October", "November", "December"]


def as_date(as_of: dt.date | str | Column) -> Column:
    """*Today* is always an argument: a date, ISO text or a column."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


_PLAIN = r"^\d{4}-\d{2}-\d{2}$"


def parse_day(value: Column | str) -> Column:
    """Calendar day of a stored date or timestamp text, null when it is neither.

    A plain ISO date, the common case, is read by a cast; only other texts are taken apart.
    """
    text = F.substring(strip(value), 1, 19)
    clock_ok = (_part(text, _ISO, 4) == "") | (
        (_number(_part(text, _ISO, 4)) < 24) & (_number(_part(text, _ISO, 5)) < 60)
        & (_number(_part(text, _ISO, 6)) < 62))
    iso = F.when(text.rlike(_ISO) & clock_ok,
                 _date(*[_part(text, _ISO, g) for g in (1, 2, 3)]))
    dmy = F.when(text.rlike(_DMY), _date(*[_part(text, _DMY, g) for g in (3, 2, 1)]))
    return F.when(col(value).rlike(_PLAIN), col(value).try_cast("date")) \
        .otherwise(F.coalesce(iso, dmy))


def _number(text: Column) -> Column:
    return text.try_cast("int")


def parse_seconds(value: Column | str) -> Column:
    """Seconds after midnight of a stored timestamp text, 0 when it has no clock part."""
    text = F.substring(strip(value), 1, 19)
    parts = [F.coalesce(_number(_part(text, _ISO, g)), F.lit(0)) for g in (4, 5, 6)]
    return F.when(F.length(col(value)) <= 10, 0) \
        .otherwise(parts[0] * 3600 + parts[1] * 60 + parts[2])


def days_since(value: Column | str, as_of) -> Column:
    """Whole days elapsed up to midnight of ``as_of``; null when undateable."""
    partial = F.when(parse_seconds(value) > 0, 1).otherwise(0)
    return F.date_diff(as_date(as_of), parse_day(value)) - partial


def age_days(as_of, posted="posted_date", seen="date_first_seen") -> Column:
    first = F.when(blank(posted) != "", col(posted)).otherwise(col(seen))
    return days_since(first, as_of)


def iso_date(value: Column | str) -> Column:
    """Date of a strict ISO text (yyyy-MM-dd or yyyyMMdd), null otherwise."""
    text = strip(value)
    return F.when(text.rlike(_PLAIN), text.try_cast("date")) \
        .when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def feed_date(value: Column | str) -> Column:
    """Date text of a feed timestamp. A leading ISO date is kept as it stands."""
    text = strip(value)
    leading = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    month_names = "|".join(_MONTHS)
    day_month = rf"(?i)^(\d{{1,2}}) +({month_names}) +(\d{{4}})$"
    month_day = rf"(?i)^({month_names}) +(\d{{1,2}}), *(\d{{4}})$"

    def month_number(name: Column) -> Column:
        return F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.initcap(name)) \
            .cast("string")

    readings = [
        F.when(text.rlike(_DMY), _date(*[_part(text, _DMY, g) for g in (3, 2, 1)])),
        F.when(text.rlike(_DMY), _date(*[_part(text, _DMY, g) for g in (3, 1, 2)])),
        F.when(text.rlike(day_month), _date(_part(text, day_month, 3),
                                            month_number(_part(text, day_month, 2)),
                                            _part(text, day_month, 1))),
        F.when(text.rlike(month_day), _date(_part(text, month_day, 3),
                                            month_number(_part(text, month_day, 1)),
                                            _part(text, month_day, 2))),
    ]
    parsed = F.coalesce(*readings).cast("string")
    return F.when(leading != "", leading).otherwise(F.coalesce(parsed, F.lit("")))


def epoch_date(value: Column | str) -> Column:
    """Date text of epoch seconds or milliseconds (above 1e11 they are milliseconds)."""
    number = col(value).try_cast("double")
    seconds = F.when(number > 1e11, number / 1000.0).otherwise(number)
    days = F.floor(seconds / 86400.0)
    in_range = days.between(-719162, 2932896)      # years 1 to 9999
    day = F.when(in_range, F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))
    return F.coalesce(day.cast("string"), F.lit(""))


def mixed_date(value: Column | str) -> Column:
    """A feed field that holds either an epoch number or a text."""
    text = strip(value)
    return F.when(text.rlike(r"^-?\d{5,}(\.\d+)?$"), epoch_date(text)) \
        .otherwise(feed_date(text))


def json_date(value: Column | str) -> Column:
    """Date text of any JSON value: numbers are epochs, texts are read as dates (digits alone are
    none), and nothing else is a date."""
    value = col(value)
    kind = F.schema_of_variant(value)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(number, epoch_date(F.try_variant_get(value, "$", "double"))) \
        .when(kind == "STRING", feed_date(F.try_variant_get(value, "$", "string"))) \
        .otherwise(F.lit(""))
