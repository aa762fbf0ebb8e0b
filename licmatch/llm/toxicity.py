"""Toxicity by FTRL-proximal logistic regression over hashed words and word pairs.

Features of a text are the distinct hashes of its words, of their stems (first bytes), of
neighbouring words and of words with one word between them. Learning rates are per coordinate, and the L1 part keeps at zero
every weight that the labels do not repeatedly ask for; what is left is small enough to send
to every task, whatever the corpus.

The classifier is fitted on at most ``max_rows`` labelled rows (those with the least hash of
their doc_id); all texts are scored whole. Labels enter nowhere else.

Defined cases: letters A-Z count as a-z and ASCII signs as white space; a null or empty text
gets the score of a text without features; several labels of one doc_id count as the highest,
a null label as none; without labelled rows every score is 0. Every row gives one row.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from licmatch.llm import words as W
from licmatch.llm.frames import texts, public_id

#: Hashed features; rows of the fitted sample at most.
DIMENSION, MAX_ROWS = 1 << 20, 16_000
#: Learning rate, its smoothing, L1 and L2, passes.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 4.0, 1.0, 8
#: Bytes of the stems of longer words.
STEMS = (6, 8)
_SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
_U = np.uint64


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of all words, stems, word pairs and skip pairs of texts."""
    hash_of = lambda **how: W.hash_words(
        data, offsets, lower=True, table=W.separators(_SIGNS), **how)
    words = hash_of()
    h = words.hashes
    text = np.repeat(np.arange(len(words)), np.diff(words.first))
    rows, hashes = [text], [W.mix(h + _U(1))]
    for length in STEMS:
        stem = hash_of(stem=length).hashes
        cut = stem != h
        rows.append(text[cut])
        hashes.append(W.mix(stem[cut] + _U(10 + length)))
    for gap in (1, 2):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            rows.append(text[gap:][same])
            hashes.append(W.join2(h[:-gap], h[gap:], seed=gap)[same])
    return np.concatenate(rows), (np.concatenate(hashes) % _U(DIMENSION)).astype(np.int64)


class Ftrl:
    """Per-coordinate state; coordinate ``DIMENSION`` is the intercept."""

    def __init__(self):
        self.z = np.zeros(DIMENSION + 1)
        self.n = np.zeros(DIMENSION + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        limit = np.where(at == DIMENSION, 0.0, L1)
        pull = np.where(np.abs(z) > limit, z - np.sign(z) * limit, 0.0)
        return -pull / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        slope = logistic(w.sum()) - label
        grown = self.n[at] + slope * slope
        self.z[at] += slope - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(place, label, features) of the rows to fit on, in one partition of bounded size."""
    chosen = (labels.where("toxic is not null and doc_id is not null")
              .where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max(F.col("toxic").cast("int")).alias("label"))
              .withColumn("place", F.xxhash64("doc_id", F.lit(11)))
              .orderBy("place", "doc_id").limit(max_rows))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, data, offsets in W.parts(batch):
                row, at = features(data, offsets)
                code = np.unique(row * DIMENSION + at)
                row, at = code // DIMENSION, code % DIMENSION
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))
                yield pa.record_batch({"place": part["place"], "label": part["label"],
                                       "features": lists})

    return (docs.join(chosen, "doc_id").select("place", "label", "text")
            .mapInArrow(run, "place long, label int, features array<int>")
            .repartition(1).sortWithinPartitions("place"))


def fit(sample: DataFrame, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero."""
    def run(batches: Iterator[pa.RecordBatch]):
        rows = [(np.append(np.asarray(f.values), DIMENSION), label) for batch in batches
                for f, label in zip(batch["features"], batch["label"].to_pylist())]
        model = Ftrl()
        for turn in range(passes if rows else 0):
            for k in np.random.default_rng(turn).permutation(len(rows)):
                model.learn(*rows[k])
        used = np.flatnonzero(model.n)
        weights = model.weights(used)
        used = used[weights != 0]
        yield pa.record_batch({"at": pa.array(used, pa.int64()),
                               "weight": pa.array(model.weights(used), pa.float64())})

    rows = sample.mapInArrow(run, "at long, weight double").collect()
    return (np.array([r["at"] for r in rows], dtype=np.int64),
            np.array([r["weight"] for r in rows], dtype=float))


def held_out():
    """Rows that are never learnt from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, at: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row."""
    context = docs.sparkSession.sparkContext
    dense = np.zeros(DIMENSION, dtype=np.float32)
    dense[at[at < DIMENSION]] = weights[at < DIMENSION]
    sent = context.broadcast(dense)
    base = float(weights[at == DIMENSION].sum()) if len(at) else -np.inf

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, data, offsets in W.parts(batch):
                row, feature = features(data, offsets)
                hit = sent.value[feature] != 0
                code = np.unique(row[hit] * DIMENSION + feature[hit])
                total = np.bincount(code // DIMENSION, minlength=part.num_rows,
                                    weights=sent.value[code % DIMENSION])
                value = logistic(total + base) if np.isfinite(base) else np.zeros(part.num_rows)
                yield pa.record_batch({"doc_id": part["doc_id"],
                                       "score": pa.array(value, pa.float64())})

    return docs.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; labels (doc_id, toxic)."""
    docs = texts(docs)
    at, weights = fit(labelled_sample(docs, labels.select("doc_id", "toxic"), max_rows))
    scored = score(docs, at, weights).select(public_id(), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
