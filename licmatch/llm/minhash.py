"""Document fingerprints by one-permutation MinHash.

The hash of each five-word shingle names one of ``BINS`` bins and a value; a bin keeps its
least value. An empty bin takes the value of a bin that a fixed random walk of its own number
leads to (optimal densification), so two texts fill an empty bin from the same place wherever
they can. A fingerprint stores the lowest ``BITS`` bits of each bin, packed as hexadecimal
text; equal bits by chance are taken out of the likeness.

Defined cases: letters A-Z count as a-z; a text of fewer words than a shingle is one shingle; a
text without words (or null) has the empty fingerprint, whose likeness is 1 to itself and 0 to
any other.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from licmatch.llm import words as W
from licmatch.llm.frames import NO_ID, texts

SHINGLE, BINS, BITS = 5, 512, 4
_U = np.uint64
_EMPTY = _U(2**64 - 1)
_BIN_BITS = BINS.bit_length() - 1
#: Ranges of doc_id per shuffle partition; hashing them to tasks then comes out even.
RANGES = 4


def densify(table: np.ndarray) -> np.ndarray:
    """Fill empty bins of rows that have at least one value."""
    out = table.copy()
    row, cell = np.nonzero((table == _EMPTY) & ~(table == _EMPTY).all(axis=1)[:, None])
    step = 0
    while len(row):
        step += 1
        at = (W.join2(cell.astype(_U), np.full(len(cell), step, dtype=_U), seed=77)
              % _U(BINS)).astype(np.int64)
        value = table[row, at]
        got = value != _EMPTY
        out[row[got], cell[got]] = value[got]
        row, cell = row[~got], cell[~got]
    return out


def signatures(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(low bits per bin, whether there is any word) of each text."""
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in bodies]))).astype(np.int64)
    words = W.hash_words(data, offsets, lower=True)
    grams = list(W.shingles(words, SHINGLE))
    row = np.repeat(np.arange(len(bodies)), [len(g) for g in grams])
    grams = np.concatenate(grams) if grams else np.zeros(0, dtype=_U)
    table = np.full(len(bodies) * BINS, _EMPTY, dtype=_U)
    at = row * BINS + (grams >> _U(64 - _BIN_BITS)).astype(np.int64)
    np.minimum.at(table, at, grams & _U(2 ** (64 - _BIN_BITS) - 1))
    table = densify(table.reshape(len(bodies), BINS))
    return (table & _U(2**BITS - 1)).astype(np.uint8), np.diff(words.first) > 0


def packed(bits: np.ndarray, filled: np.ndarray) -> list[str]:
    """Two bins to a byte, as hexadecimal text."""
    pairs = (bits[:, ::2] << BITS) | bits[:, 1::2]
    return [p.tobytes().hex() if f else "" for p, f in zip(pairs, filled)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated Jaccard similarity: the share of equal bins without those equal by chance."""
    chance = 2.0**-BITS
    equal = (a[0] == b[0]).mean(axis=1)
    value = np.clip((equal - chance) / (1 - chance), 0, 1)
    return np.where(a[1] & b[1], value, (a[1] == b[1]).astype(float))


def in_order(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text, guest): documents by descending doc_id in ranges, every range
    followed by a guest, the first document of the next range (of the first, after the last).

    Only bounds of the ranges and the first id of each come to the driver.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = RANGES * tasks
    quantiles = docs.select(F.col("doc_id").cast("double")).approxQuantile(
        "doc_id", [k / count for k in range(1, count)], 0.1 / count) if count > 1 else []
    limits = sorted({int(min(q, 2.0**62)) for q in quantiles})
    array = F.array(*[F.lit(b).cast("long") for b in limits]) if limits else \
        F.expr("cast(array() as array<bigint>)")
    part = F.size(F.filter(array, lambda b: b >= F.col("doc_id")))
    placed = docs.withColumn("part", part)
    firsts = {r.part: r.first for r in
              placed.groupBy("part").agg(F.max("doc_id").alias("first")).collect()}
    used = sorted(firsts)
    host = {used[k]: used[k - 1] for k in range(len(used))}
    slots = range(len(limits) + 1)
    first_of = F.array(*[F.lit(firsts.get(p, -1)).cast("long") for p in slots])
    host_of = F.array(*[F.lit(host.get(p, -1)) for p in slots])
    here = F.struct(F.col("part"), F.lit(False).alias("guest"))
    there = F.struct(F.element_at(host_of, F.col("part") + 1).alias("part"),
                     F.lit(True).alias("guest"))
    copies = F.when(F.element_at(first_of, F.col("part") + 1) == F.col("doc_id"),
                    F.array(here, there)).otherwise(F.array(here))
    return (placed.select("doc_id", "text", F.explode(copies).alias("at"))
            .select("at.part", "doc_id", "text", "at.guest")
            .repartition(tasks, "part")
            .sortWithinPartitions("part", "guest", F.desc("doc_id"), "text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as
    many first ones of the next document (all, if it has fewer). Rows with one doc_id follow
    each other in the order of their texts.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        rows, before, size = [], None, 0

        def finish():
            chain = [r[1].encode() for r in rows]
            edited = []
            for (_, text, _), (_, following, _) in zip(rows, rows[1:]):
                half = len(text) // 2
                edited.append((text[:len(text) - half] + following[:half]).encode())
            own, other = signatures(chain), signatures(edited)
            keep = [k for k in range(len(edited)) if not rows[k][2]]
            first = (own[0][:-1][keep], own[1][:-1][keep])
            after = (own[0][1:][keep], own[1][1:][keep])
            other = (other[0][keep], other[1][keep])
            ids = [rows[k][0] for k in keep]
            return pa.record_batch({
                "doc_id": pa.array([None if i == NO_ID else i for i in ids], pa.int64()),
                "n_chars": pa.array([len(rows[k][1]) for k in keep], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(edited[k]).hexdigest() for k in keep],
                                          pa.string()),
                "fingerprint": pa.array(packed(*first), pa.string()),
                "edited_fingerprint": pa.array(packed(*other), pa.string()),
                "near_edited": pa.array(likeness(first, other), pa.float64()),
                "near_next": pa.array(likeness(first, after), pa.float64())})

        for batch in batches:
            for part, doc_id, text, guest in zip(*[batch[c].to_pylist() for c in
                                                   ("part", "doc_id", "text", "guest")]):
                if guest and before == (part, True):
                    continue  # repeated rows of the guest
                before = (part, guest)
                rows.append((doc_id, text, guest))
                size += len(text)
                if size > W.PART_BYTES and len(rows) > 1:
                    yield finish()
                    rows, size = rows[-1:], len(text)
        if len(rows) > 1:
            yield finish()

    return in_order(texts(docs)).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
