"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of words with smallest period q, at least ``max(MIN_LENGTH, 2 q)`` long,
that no neighbouring word extends. The texts of a part of a batch are laid into one sequence
with a number between them that occurs once, so no run crosses texts.

* Periods up to ``SMALL`` are read off directly: words q apart that agree, in a row.
* Longer periods are found at dyadic scales t = 4, 8, 16, ...: scale t finds the periods from
  ``3 t - 1`` to ``6 t - 2``. Among the hashes of all t-word blocks, those inside a region of
  period at most t / 3 left out, position i is chosen if the least hash of the blocks at
  i .. i + t is that of block i or of block i + t. That depends on the 2 t words at i alone, so
  a run of period q holds a chosen position whose partner q words on is chosen too, with the same
  2 t words: equal contexts q apart propose the period q there.
* Such a pair is missing only where the run is highly periodic itself. Those regions are runs
  of period at most t / 3, known from smaller scales; their ends at distance q, and pairs of
  them that touch, propose the omitted periods.

Every proposal is extended to both sides over the block hashes and compared word by word in the
end, so a hash collision can't change a result. Chosen positions with one context are more than
t / 3 apart, so a position has at most 18 partners: nothing is capped.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from licmatch.llm.frames import texts, public_id
from licmatch.llm.words import join2, mix, parts

MIN_LENGTH = 12
#: Periods compared directly; the first scale starts right after them.
SMALL = 10
FIRST_SCALE = 4

_U = np.uint64
_TOP = _U(2**64 - 1)

SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, "
          "exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def _stretches(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of the maximal stretches of consecutive numbers in sorted ``hits``."""
    if not len(hits):
        return hits, hits
    cuts = np.flatnonzero(np.diff(hits) > 1) + 1
    first = np.concatenate(([0], cuts))
    return hits[first], np.diff(np.concatenate((first, [len(hits)])))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    reach, out = 1, x
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


class _Blocks:
    """Hashes of all blocks of 2^k words, for as many k as asked for."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.levels = [mix(words.astype(_U) + _U(0x2545F4914F6CDD1D))]

    def level(self, k: int) -> np.ndarray:
        """Hashes of the blocks at 0, 1, ...; shorter than the words by 2^k - 1."""
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(join2(last[:-half], last[half:]) if len(last) > half else last[:0])
        return self.levels[k]

    def _walk(self, a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
        """How far the words from a and b on (or, with -1, right before them) agree; a < b."""
        out = np.zeros(len(a), dtype=np.int64)
        top = len(self.levels) - 1
        active = np.arange(len(a))
        for k in [*range(top, -1, -1)]:
            hashes, size = self.levels[k], 1 << k
            rows = active if k == top else np.arange(len(a))
            while len(rows):
                low, high = ((a[rows] + out[rows], b[rows] + out[rows]) if sign > 0 else
                             (a[rows] - out[rows] - size, b[rows] - out[rows] - size))
                fits = (low >= 0) & (high < len(hashes))
                rows, low, high = rows[fits], low[fits], high[fits]
                rows = rows[hashes[low] == hashes[high]]
                out[rows] += size
                if k < top:  # a second block of this size would have been one of the next
                    break
        return out

    def extend(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal [start, end) with the period around the words at ``at`` and ``at + period``."""
        return (at - self._walk(at, at + period, -1),
                at + period + self._walk(at, at + period, 1))


def _small_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) for periods up to ``SMALL``, also shorter ones of three periods."""
    found = []
    for q in range(1, min(SMALL, len(words) // 2) + 1):
        first, count = _stretches(np.flatnonzero(words[:-q] == words[q:]))
        end = first + count + q
        size = end - first
        long = ((size >= max(MIN_LENGTH, 2 * q)) | (size >= max(FIRST_SCALE, 3 * q)))
        found += zip(first[long].tolist(), end[long].tolist(), [q] * int(long.sum()))
    return found


def _exact(words: np.ndarray, start: int, end: int, q: int) -> tuple[int, int] | None:
    """The extended stretch compared word by word; the parts that agree if hashes collided."""
    same = words[start:end - q] == words[start + q:end]
    outside = ((start > 0 and words[start - 1] == words[start - 1 + q])
               or (end < len(words) and words[end] == words[end - q]))
    return (start, end) if same.all() and not outside else None


def find_runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period, as an (m, 3) array."""
    known: dict[tuple[int, int], int] = {}  # (start, end) to smallest period

    def keep(start: int, end: int, q: int) -> None:
        if known.get((start, end), q + 1) > q:
            known[(start, end)] = q

    for run in _small_runs(words):
        keep(*run)
    blocks = _Blocks(words)
    scale, k = FIRST_SCALE, FIRST_SCALE.bit_length() - 1
    while 2 * (3 * scale - 1) <= len(words):
        least, most = 3 * scale - 1, 6 * scale - 2
        hashes, contexts = blocks.level(k), blocks.level(k + 1)
        periodic = np.array([(s, e, q) for (s, e), q in known.items()
                             if 3 * q <= scale <= e - s], dtype=np.int64).reshape(-1, 3)
        masked = hashes
        if len(periodic):
            edge = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(edge, periodic[:, 0], 1)
            np.add.at(edge, periodic[:, 1] - scale + 1, -1)
            masked = np.where(np.cumsum(edge[:-1]) > 0, _TOP, hashes)
        lowest = _sliding_min(masked, scale + 1)
        lowest = lowest[:len(contexts)]
        chosen = np.flatnonzero(((lowest == masked[:len(lowest)])
                                 | (lowest == masked[scale:scale + len(lowest)]))
                                & (lowest != _TOP))
        context = contexts[chosen]
        order = np.lexsort((chosen, context))
        chosen, context = chosen[order], context[order]
        at, period = [], []
        lag, repeated = 1, False
        while lag < len(chosen):
            apart = chosen[lag:] - chosen[:-lag]
            near = (context[lag:] == context[:-lag])
            repeated |= bool(near.any())
            near &= apart <= most
            if not near.any():
                break
            pick = np.flatnonzero(near & (apart >= least))
            at.append(chosen[pick])
            period.append(apart[pick])
            lag += 1
        regions = periodic[periodic[:, 1] - periodic[:, 0] >= least]
        if len(regions):
            more_at, more_period = _between_regions(regions, least, most)
            at.append(more_at)
            period.append(more_period)
        if at:
            at, period = np.concatenate(at), np.concatenate(period)
            start, end = blocks.extend(at, period)
            long = end - start >= np.maximum(MIN_LENGTH, 2 * period)
            runs = np.unique(np.stack((start[long], end[long], period[long]), axis=1), axis=0)
            for s, e, q in runs.tolist():
                if (stretch := _exact(words, s, e, q)) is not None:
                    keep(*stretch, q)
                else:  # a hash collision: read this period off directly
                    first, count = _stretches(np.flatnonzero(words[:-q] == words[q:]))
                    for f, c in zip(first.tolist(), count.tolist()):
                        if c + q >= max(MIN_LENGTH, 2 * q):
                            keep(f, f + c + q, q)
        if not repeated and not len(regions):
            break  # nothing of 2 t words occurs twice, so no longer period does
        scale, k = 2 * scale, k + 1
    rows = [(s, e - s, q) for (s, e), q in known.items() if e - s >= max(MIN_LENGTH, 2 * q)]
    rows.sort(key=lambda run: (run[0], run[2]))
    return np.array(rows, dtype=np.int64).reshape(-1, 3)


def _between_regions(regions: np.ndarray, least: int, most: int):
    """Proposals from highly periodic regions: ends one period apart, and regions that touch."""
    at, period = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    by_end = regions[np.lexsort((regions[:, 1], regions[:, 2]))]
    for lag in range(1, len(by_end)):
        apart = by_end[lag:, 1] - by_end[:-lag, 1]
        near = (by_end[lag:, 2] == by_end[:-lag, 2]) & (apart <= most)
        if not near.any():
            break
        pick = np.flatnonzero(near & (apart >= least))
        at.append(by_end[pick, 1] - 1)
        period.append(apart[pick])
    by_start = regions[np.lexsort((regions[:, 0], regions[:, 2]))]
    left, right = by_start[:-1], by_start[1:]
    touch = (left[:, 2] == right[:, 2]) & (right[:, 0] <= left[:, 1])
    for (a, b, _), (c, d, _) in zip(left[touch].tolist(), right[touch].tolist()):
        q = np.arange(least, min(most, b - a, d - c, (d - a) // 2) + 1)
        at.append(np.minimum(b, d - q) - 1)
        period.append(q)
    return np.concatenate(at), np.concatenate(period)


def _planted(words: list, doc_id: int | None) -> list:
    """Every tenth document repeats a stretch of its own words, as its id says."""
    code = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if not words or code is None or code % 10:
        return words
    g, n = code // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _part_rows(ids: list, documents: list[list[bytes]]) -> Iterator[tuple]:
    numbers: dict[bytes, int] = {}
    sequence: list[int] = []
    first = []
    for i, words in enumerate(documents):
        first.append(len(sequence))
        sequence += [numbers.setdefault(word, len(numbers)) for word in words]
        sequence.append(-1 - i)  # occurs once
    runs = find_runs(np.array(sequence, dtype=np.int64))
    bounds = np.searchsorted(runs[:, 0], first + [len(sequence)])
    for i, words in enumerate(documents):
        own = runs[bounds[i]:bounds[i + 1]]
        if not len(own):
            yield ids[i], 0, None, None, None, None, _digest(b""), _digest(b" ".join(words))
            continue
        own = own - np.array([first[i], 0, 0])
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, own[:, 0] + own[:, 2], 1)
        np.add.at(edge, own[:, 0] + own[:, 1], -1)
        stays = np.cumsum(edge[:-1]) == 0
        start, length, period = max(own.tolist(), key=lambda r: (r[1], -r[0], -r[2]))
        yield (ids[i], len(own), start, length, period, 1000 * length // period,
               _digest("".join(f"{s},{n},{q}\n" for s, n, q in own.tolist()).encode()),
               _digest(b" ".join(w for w, stay in zip(words, stays.tolist()) if stay)))


def _batches(planted: bool):
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from licmatch.llm.frames import NO_ID
        for batch in batches:
            for piece, data, offsets in parts(batch):
                ids = piece.column("doc_id").to_pylist()
                raw, base = data[offsets[0]:offsets[-1]].tobytes(), int(offsets[0])
                edges = (offsets - base).tolist()
                # bytes.split() without an argument cuts at the space and bytes 9 to 13
                documents = [raw[a:b].split() for a, b in zip(edges, edges[1:])]
                if planted:
                    documents = [_planted(words, None if i == NO_ID else i)
                                 for words, i in zip(documents, ids)]
                columns = list(zip(*_part_rows(ids, documents)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds)], names)
    return run


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """One row per document: its number of runs, the longest one, digests of all runs and of the
    text with every repetition collapsed to its first period.

    ``planted`` makes every tenth document (by its id) repeat a stretch first, a self-test that
    needs no other data. A null, empty or blank text has no run, four nulls and the digests of
    empty strings. Ties between longest runs go to the smallest start, then period. A row
    without id is never changed by ``planted``; repeated rows give repeated results.
    """
    found = texts(docs).mapInArrow(_batches(planted), SCHEMA)
    return found.select(public_id(), *found.columns[1:])
