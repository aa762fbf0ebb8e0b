"""Words of whole Arrow batches as 64-bit hashes, computed over byte buffers with numpy.

A word is a longest run of bytes that are not separators. By default separators are the space
and the bytes 9 to 13, so words are those of ``[^\\x20\\x09-\\x0D]+``.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text handled at once inside a task; longer texts are handled alone.
PART_BYTES = 1 << 22
#: Words of more bytes are hashed one by one.
LONG_WORD = 256

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=_U)


def separators(characters: bytes = SPACES) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def join2(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _U(0x9E6C63D0876A9A47) + (b ^ _U(0xA0761D6478BD642F + seed)))


class Words:
    """``hashes`` of all words of a list of texts; text i has ``hashes[first[i]:first[i + 1]]``."""

    __slots__ = ("hashes", "first")

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.hashes, self.first = hashes, first

    def __len__(self) -> int:
        return len(self.first) - 1


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False,
               table: np.ndarray | None = None, stem: int | None = None) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8 bytes), or their first
    ``stem`` bytes."""
    base = int(offsets[0])
    data, offsets = data[base:int(offsets[-1])], offsets - base
    size = len(data)
    if size == 0:
        return Words(np.zeros(0, dtype=_U), np.zeros(len(offsets), dtype=np.int64))
    inside = ~(separators() if table is None else table)[data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= edge[1:size] | ~inside[:-1]
    end = inside.copy()
    end[:-1] &= edge[1:size] | ~inside[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    padded = np.zeros(size + 8, dtype=np.uint8)
    padded[:size] = _LOWER[data] if lower else data
    eight = np.ndarray((size + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    if stem is not None:
        ends = np.minimum(ends, starts + stem)
    lengths = ends - starts
    hashes = mix(lengths.astype(_U) + _U(0x51ED270B9F1D6A35))
    short = np.minimum(lengths, 8)
    hashes = join2(hashes, eight[starts] & _MASK[short])
    rest = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
    at = 8
    while len(rest):
        left = np.minimum(lengths[rest] - at, 8)
        hashes[rest] = join2(hashes[rest], eight[starts[rest] + at] & _MASK[left])
        at += 8
        rest = rest[lengths[rest] > at]
    for i in np.flatnonzero(lengths > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(padded[starts[i]:ends[i]].tobytes())
    return Words(hashes, np.searchsorted(starts, offsets).astype(np.int64))


def ngrams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of n consecutive hashes (none if there are fewer)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=_U)
    out = join2(np.full(count, n, dtype=_U), hashes[:count], seed)
    for k in range(1, n):
        out = join2(out, hashes[k:k + count], seed)
    return out


def shingles(words: Words, n: int) -> Iterator[np.ndarray]:
    """Per text the hashes of its n-word runs; a shorter text is one run, an empty one none."""
    grams = ngrams(words.hashes, n)
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if hi - lo >= n:
            yield grams[lo:hi - n + 1]
        elif hi > lo:
            yield ngrams(words.hashes[lo:hi], hi - lo, seed=1)
        else:
            yield grams[:0]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1,
                            offset=8 * column.offset)
    return np.frombuffer(data or b"", dtype=np.uint8), offsets


def parts(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple]:
    """(batch slice, bytes, offsets) in slices of about ``PART_BYTES`` of text."""
    if batch.num_rows == 0:
        return
    data, offsets = buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + PART_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo), data, offsets[lo:hi + 1]
        lo = hi
