"""Removal of long repeated word sequences by recompression.

Texts are compressed in rounds: first runs of one word, then pairs of neighbours, become new
symbols, and again on the shorter sequence. The name of a symbol is a hash of what it stands
for, hence global: equal parts get equal names in every document without a dictionary that
tasks would have to share. Whether two neighbours form a pair depends on their names only, so
the symbols inside equal substrings agree, except near the ends.

Every symbol carries the range of words its making depended on, and is named after them in the
end. A window of ``width`` words that contains this range holds the symbol wherever the window
occurs; the least name among its highest symbols is the window's anchor (a window without one,
as in long runs of a word, is its own anchor). A window
repeats in another text only if its anchor does, so only windows with an anchor found in two
different texts are looked at word by word (128-bit hashes), and this settles the repeats.

Equal texts are handled as one text. What is joined or counted is partially aggregated first,
and a window that very many texts share is a skewed join key that Spark splits.

Defined cases: null text is empty; a text shorter than the window loses nothing; rows with one
doc_id never remove each other's words; rows without doc_id come after all others. Every row
gives one row.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from licmatch.llm import words as W
from licmatch.llm.frames import drop_staged, public_id, stage, texts

WIDTH = 13
_U = np.uint64
_NONE = _U(2**64 - 1)


class Symbols:
    """A compressed sequence: names, the words each symbol covers, those it depends on."""

    __slots__ = ("names", "start", "end", "lo", "hi", "doc")

    def __init__(self, names, start, end, lo, hi, doc):
        self.names, self.start, self.end = names, start, end
        self.lo, self.hi, self.doc = lo, hi, doc


def word_symbols(words: W.Words) -> Symbols:
    at = np.arange(len(words.hashes), dtype=np.int64)
    doc = np.repeat(np.arange(len(words), dtype=np.int64), np.diff(words.first))
    return Symbols(words.hashes, at, at + 1, at, at + 1, doc)


def _sides(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Dependence that includes the neighbour left and right; past a text's end if there is
    none, so that no window can hold it."""
    lo, hi = s.start - 1, s.end + 1
    joined = s.doc[1:] == s.doc[:-1]
    lo[1:] = np.where(joined, s.lo[:-1], lo[1:])
    hi[:-1] = np.where(joined, s.hi[1:], hi[:-1])
    return lo, hi


def compress_runs(s: Symbols, level: int) -> Symbols:
    """Every longest run of one name becomes a symbol named after it and its length."""
    if not len(s.names):
        return s
    new = np.ones(len(s.names), dtype=bool)
    new[1:] = (s.names[1:] != s.names[:-1]) | (s.doc[1:] != s.doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    lo, hi = _sides(s)
    names = W.join2(s.names[first], (last - first).astype(_U), seed=1000 + level)
    return Symbols(names, s.start[first], s.end[last], lo[first], hi[last], s.doc[first])


def compress_pairs(s: Symbols, level: int) -> Symbols:
    """A left symbol and a right symbol side by side become one; the name says which is which."""
    if not len(s.names):
        return s
    right = (W.mix(s.names + _U(level)) & _U(1)).astype(bool)
    pair = np.zeros(len(right), dtype=bool)
    pair[:-1] = ~right[:-1] & right[1:] & (s.doc[1:] == s.doc[:-1])
    second = np.zeros(len(right), dtype=bool)
    second[1:] = pair[:-1]
    at = np.flatnonzero(~second)
    to = at + pair[at]
    lo, hi = _sides(s)
    alone = ~pair[at]
    names = np.where(alone, s.names[at], W.join2(s.names[at], s.names[to], seed=2000 + level))
    return Symbols(names, s.start[at], s.end[to],
                   np.where(alone & right[at], lo[at], s.lo[at]),
                   np.where(alone & ~right[at], hi[at], s.hi[to]), s.doc[at])


def window_anchors(words: W.Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(starts, anchors) of all windows: positions in ``words`` and the names they meet under."""
    size = len(words.hashes)
    last = np.repeat(words.first[1:], np.diff(words.first)) - width
    starts = np.flatnonzero(np.arange(size) <= last)
    anchors = np.full(size, _NONE, dtype=_U)
    top = word_symbols(words)
    for level in (1, 2):
        top = compress_pairs(compress_runs(top, level), level)
    # A symbol goes by all words that it depends on: few of them are shared by chance.
    fits = np.flatnonzero((top.hi - top.lo <= width) & (top.lo >= 0))
    lo, hi = top.lo[fits], top.hi[fits]
    names = range_hashes(words.hashes, lo, np.minimum(hi, size))
    for back in range(width):
        # The window [at, at + width) holds the symbol's dependence.
        at = lo - back
        holds = np.flatnonzero((hi <= at + width) & (at >= 0))
        np.minimum.at(anchors, at[holds], names[holds])
    bare = starts[anchors[starts] == _NONE]
    if len(bare):
        anchors[bare] = ngram_at(words.hashes, bare, width, 3)
    return starts, anchors[starts]


def range_hashes(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each run of words [lo, hi), from sums over the powers of an odd number."""
    odd = 0x9E3779B97F4A7C15
    power = np.cumprod(np.full(len(hashes), odd, dtype=_U))
    inverse = np.cumprod(np.full(len(hashes), pow(odd, -1, 2**64), dtype=_U))
    sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(hashes * power)))
    return W.join2((sums[hi] - sums[lo]) * inverse[lo], (hi - lo).astype(_U), seed=9)


def ngram_at(hashes: np.ndarray, starts: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the windows that begin at ``starts``."""
    out = np.full(len(starts), width, dtype=_U)
    for k in range(width):
        out = W.join2(out, hashes[starts + k], seed)
    return out


def _per_text(values: np.ndarray, starts: np.ndarray, words: W.Words) -> Iterator[tuple]:
    """(starts within the text, values) for each text."""
    cut = np.searchsorted(starts, words.first)
    for k in range(len(words)):
        lo, hi = cut[k], cut[k + 1]
        yield starts[lo:hi] - words.first[k], values[lo:hi]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64)))


def _version(content: bytes) -> int:
    return int.from_bytes(content[:8], "big", signed=True)


def _text_bytes(data, offsets) -> list[bytes]:
    return [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def anchor_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, content, version, n_words, sha, anchors): distinct anchors of a text's windows.

    ``content`` is the text's SHA-256, ``version`` its first eight bytes: with the doc_id they
    name a text even where one doc_id has several.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, data, offsets in W.parts(batch):
                words = W.hash_words(data, offsets)
                starts, anchors = window_anchors(words, width)
                bodies = _text_bytes(data, offsets)
                content = [hashlib.sha256(b).digest() for b in bodies]
                yield pa.record_batch({
                    "doc_id": part["doc_id"], "content": pa.array(content, pa.binary()),
                    "version": pa.array([_version(c) for c in content], pa.int64()),
                    "n_words": pa.array(np.diff(words.first), pa.int64()),
                    "sha": pa.array([hashlib.sha256(b" ".join(b.split())).hexdigest()
                                     for b in bodies], pa.string()),
                    "anchors": _lists([np.unique(v) for _, v in
                                       _per_text(anchors.view(np.int64), starts, words)])})

    return docs.mapInArrow(run, "doc_id long, content binary, version long, n_words long, "
                                "sha string, anchors array<long>")


def window_table(bodies: DataFrame, width: int) -> DataFrame:
    """(doc_id, version, starts, h1, h2): a text's windows under one of its shared anchors."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, data, offsets in W.parts(batch):
                words = W.hash_words(data, offsets)
                starts, anchors = window_anchors(words, width)
                shared = part["shared"]
                all_at, one, two = [], [], []
                for k, (at, names) in enumerate(_per_text(anchors.view(np.int64), starts, words)):
                    at = at[np.isin(names, np.asarray(shared[k].values))]
                    here = at + words.first[k]
                    all_at.append(at)
                    one.append(ngram_at(words.hashes, here, width, 4).view(np.int64))
                    two.append(ngram_at(words.hashes, here, width, 5).view(np.int64))
                yield pa.record_batch({"doc_id": part["doc_id"], "version": part["version"],
                                       "start": _lists(all_at), "h1": _lists(one),
                                       "h2": _lists(two)})

    return bodies.select("doc_id", "version", "text", "shared").mapInArrow(
        run, "doc_id long, version long, start array<long>, h1 array<long>, h2 array<long>")


def cut_table(bodies: DataFrame, width: int) -> DataFrame:
    """(owner, version, n_removed, kept, kept_sha): texts without their windows in ``removed``."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n_removed, kept, sha = [], [], []
            for text, removed in zip(batch["text"].to_pylist(), batch["removed"]):
                words = text.encode().split()
                change = np.zeros(len(words) + 1, dtype=np.int64)
                at = np.asarray(removed.values)
                np.add.at(change, at, 1)
                np.add.at(change, at + width, -1)
                stays = np.cumsum(change[:-1]) == 0
                left = b" ".join([w for w, s in zip(words, stays.tolist()) if s])
                n_removed.append(len(words) - int(stays.sum()))
                kept.append(left.decode())
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.record_batch({"owner": batch["doc_id"], "version": batch["version"],
                                   "n_removed": pa.array(n_removed, pa.int64()),
                                   "kept": pa.array(kept, pa.string()),
                                   "kept_sha": pa.array(sha, pa.string())})

    return bodies.select("doc_id", "version", "text", "removed").mapInArrow(
        run, "owner long, version long, n_removed long, kept string, kept_sha string")


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) per row of ``docs``.

    Each word covered by a window of ``width`` words that also starts in a document with a
    smaller doc_id is removed. ``kept`` has the words left, joined by one space, where some but
    not all words were removed, and is null otherwise.
    """
    docs = texts(docs)
    table = stage(anchor_table(docs, width))
    # A content's owner is its smallest doc_id; the other rows of a content are copies of it.
    owners = table.groupBy("content", "version").agg(
        F.min("doc_id").alias("owner"), F.min_by("anchors", "doc_id").alias("anchors"))
    anchors = owners.select("owner", "version", F.explode("anchors").alias("anchor"))
    common = (anchors.groupBy("anchor")
              .agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"))
              .where("lo < hi").select("anchor"))
    shared = stage(anchors.join(common, "anchor").groupBy("owner", "version")
                   .agg(F.collect_list("anchor").alias("shared")))
    # From here on nothing reads the anchors of all texts.
    every, table = table, stage(table.drop("anchors"))
    drop_staged(every)
    owners = table.groupBy("content", "version").agg(F.min("doc_id").alias("owner"))

    # The owners' texts that share an anchor.
    version = F.expr("cast(conv(substr(sha2(text, 256), 1, 16), 16, -10) as long)")
    bodies = stage(docs.join(shared.withColumnRenamed("owner", "doc_id"), "doc_id")
                   .where(version == F.col("version")))
    windows = stage(window_table(bodies, width)
                    .select("doc_id", "version", F.arrays_zip("start", "h1", "h2").alias("w"))
                    .selectExpr("doc_id", "version", "inline(w)"))
    first = stage(windows.groupBy("h1", "h2")
                  .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                  .where("lo < hi").select("h1", "h2", "lo"))
    removed = stage(windows.join(first, ["h1", "h2"]).where("doc_id > lo")
                    .groupBy("doc_id", "version").agg(F.collect_set("start").alias("removed")))
    # Repeated rows of one doc_id and text give equal results.
    cut = (cut_table(bodies.join(removed, ["doc_id", "version"]), width)
           .dropDuplicates(["owner", "version"]))

    rows = (table.drop("anchors")
            .join(owners.select("content", "owner"), "content")
            .join(cut, ["owner", "version"], "left"))
    copy = (F.col("doc_id") > F.col("owner")) & (F.col("n_words") >= width)
    return rows.select(
        public_id(), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
        .alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha"))
        .alias("kept_sha256"),
        F.when(~copy, F.col("kept")).alias("kept"))
