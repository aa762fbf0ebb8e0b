"""Spans of pattern matches as column expressions.

Matches are wrapped in a mark character and the text is split at the marks: every second piece
is a match, and the lengths of the pieces before it give its place in code points. The text's
own marks are first replaced by another character that no pattern names.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

_MARK, _OTHER = "\u0001", "\u0002"
#: Matches put together at once.
BLOCK = 128
SPANS = "array<struct<start:int,kind:int,end:int,body:string,left:string,right:string>>"


def none() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def pieces(text: str, pattern: str, needs: str | None = None) -> Column:
    """The text cut at all leftmost non-overlapping matches; ``needs`` is a character string
    without which there is none. Compute it as a column of its own before ``spans``."""
    clean = F.translate(text, _MARK, _OTHER)
    cut = F.split(F.regexp_replace(clean, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    return cut if needs is None else F.when(F.contains(F.col(text), F.lit(needs)), cut).otherwise(
        F.array(F.lit("")))


def spans(cut: str, kind: int, context: int = 0) -> Column:
    """Array of (start, kind, end, body, left, right) of the matches in a column of pieces;
    ``left`` and ``right`` are up to ``context`` characters beside the match."""
    at = lambda k: F.element_at(F.col(cut), k.cast("int"))

    def step(state, k):
        before, body = at(2 * k - 1), at(2 * k)
        start = state["at"] + F.char_length(before)
        end = start + F.char_length(body)
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
                        body.alias("body"), F.right(before, F.lit(context)).alias("left"),
                        F.left(at(2 * k + 1), F.lit(context)).alias("right"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    def block(state, b):
        """The matches of one block; a growing array is copied per block, not per match."""
        begin = F.struct(state["at"].alias("at"), none().alias("found"))
        inner = F.aggregate(F.sequence(BLOCK * b + 1, F.least(BLOCK * (b + 1), count)), begin, step)
        return F.struct(inner["at"].alias("at"), F.concat(state["found"], inner["found"])
                        .alias("found"))

    begin = F.struct(F.lit(0).alias("at"), none().alias("found"))
    count = F.expr(f"cast((size(`{cut}`) - 1) / 2 as int)")
    blocks = F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))
    found = F.aggregate(blocks, begin, block, lambda s: s["found"])
    return F.when(F.size(cut) > 1, found).otherwise(none())


def listed(found: Column, kinds: list[str]) -> Column:
    """kind:start:end of the spans by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_of(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
