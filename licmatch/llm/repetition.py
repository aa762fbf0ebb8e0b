"""Quality rules on repetition inside a document, read off its suffix array.

The suffixes of the word sequence are ranked by prefix doubling until all ranks differ. The
longest common prefix of neighbours in that order bounds the maximal repeated substrings: a
suffix and its neighbour share exactly that many words, and no longer repeat starts there. The
spans of repeats of at least ``min_repeat`` words are united; a document is rejected if they
cover too large a fraction of it, or if one repeat is too long a part of it.

Defined cases: a null or empty text has no words and fails the base rule (fewer than 50
words); every row gives one row, with or without doc_id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Defaults of the verdict, over the words of a document.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.4, 0.25
MIN_WORDS = 50
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def word_ids(text: str) -> np.ndarray:
    """Words of ``[^\\x20\\x09-\\x0D]+`` as numbers; equal words have equal numbers."""
    seen: dict[bytes, int] = {}
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64,
                       count=len(words))


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes, and the rank of every suffix by its first 1, 2, 4, ... words."""
    size = len(ids)
    ranks = [ids]
    order = np.argsort(ids, kind="stable")
    width = 1
    while True:
        rank = ranks[-1]
        key = (rank + 1) * (size + 2)
        key[:max(size - width, 0)] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(size, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        ranks.append(new)
        width *= 2
        if width >= size or new[order[-1]] == size - 1:
            return order, ranks


def neighbour_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix, in words, of each suffix with the one before it in the order."""
    size = len(order)
    common = np.zeros(size, dtype=np.int64)
    if size < 2:
        return common
    a, b = order[1:].copy(), order[:-1].copy()
    got = np.zeros(size - 1, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank, width = ranks[level], 1 << level
        inside = np.maximum(a, b) + width <= size
        same = inside.copy()
        same[inside] = rank[a[inside]] == rank[b[inside]]
        got[same] += width
        a[same] += width
        b[same] += width
    common[1:] = got
    return common


def repeats(ids: np.ndarray) -> np.ndarray:
    """For each word position the length of the longest repeated substring starting there."""
    longest = np.zeros(len(ids), dtype=np.int64)
    if len(ids) > 1:
        order, ranks = suffix_array(ids)
        common = neighbour_prefixes(order, ranks)
        both = np.maximum(common, np.append(common[1:], 0))
        longest[order] = both
    return longest


def covered(longest: np.ndarray, least: int, width: int | None = None) -> int:
    """Words in the union of repeats of at least ``least`` words (or of their first ``width``)."""
    at = np.flatnonzero(longest >= least)
    size = len(longest)
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + (longest[at] if width is None else width), -1)
    return int((np.cumsum(change[:size]) > 0).sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            again += line in seen
            seen.add(line)
    return again


def measure(text: str, min_repeat: int) -> tuple[int, int, int, int, int, int, int]:
    ids = word_ids(text)
    longest = repeats(ids)
    return (len(ids), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)),
            repeated_lines(text), covered(longest, 3, 3), covered(longest, min_repeat),
            int(longest.max(initial=0)))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "covered_words", "longest_repeat"]


def _named(measure_name: str) -> str:
    """Column name of a measure beside the columns of the documents."""
    return f"_repetition_{measure_name}"


def with_measures(docs: DataFrame, columns: list[str], min_repeat: int) -> DataFrame:
    """The given columns of ``docs`` (they must have ``text`` among them) and the measures."""
    source = docs.select(*[F.col(f"`{c}`") for c in columns])
    schema = T.StructType(source.schema.fields
                          + [T.StructField(_named(c), T.LongType()) for c in COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                rows = [measure(t or "", min_repeat) for t in batch["text"].to_pylist()]
                extra = [pa.array(x, pa.int64()) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    batch.columns + extra, names=batch.schema.names + [_named(c) for c in COLUMNS])

    return source.mapInArrow(run, schema)


def verdict(max_covered: float, max_longest: float):
    """(base_failed, kept) of the columns that ``with_measures`` adds."""
    base = (F.col(_named("n_words")) < MIN_WORDS) | (100 * F.col(_named("n_repeat_words"))
                                              > 50 * F.col(_named("n_words")))
    repetitive = ((F.col(_named("covered_words")) > max_covered * F.col(_named("n_words")))
                  | (F.col(_named("longest_repeat")) > max_longest * F.col(_named("n_words"))))
    return base, ~base & ~repetitive


def quality_table(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
                  max_longest: float = MAX_LONGEST) -> DataFrame:
    """Per row of ``docs``: doc_id, the measures, base_failed, kept, covered, longest repeat."""
    base, kept = verdict(max_covered, max_longest)
    return with_measures(docs, ["doc_id", "text"], min_repeat).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(_named(c)).alias(c) for c in COLUMNS[:5]],
        base.alias("base_failed"), kept.alias("kept"),
        *[F.col(_named(c)).alias(c) for c in COLUMNS[5:]])


def keep_quality(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
                 max_longest: float = MAX_LONGEST) -> DataFrame:
    """``docs`` without the rows that the rules reject; all columns stay."""
    kept = verdict(max_covered, max_longest)[1]
    return (with_measures(docs, docs.columns, min_repeat).where(kept)
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
