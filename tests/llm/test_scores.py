"""Toxicity, fingerprints and source mix: accuracy, definitions and odd rows."""
from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from licmatch.llm import minhash, mixture, toxicity
from tests_llm_rows import ODD_ROWS


# -- toxicity --------------------------------------------------------------------------------

def test_scores_find_planted_words(spark, frame, prose):
    r, bad = random.Random(3), ["vile", "rotten", "grubsome", "grublike", "grubby"]
    rows, labels = [], []
    for k in range(900):
        words, toxic = prose(k, r.randint(10, 200)).split(), int(k % 8 == 0)
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(bad).upper() + ",")
        rows.append((k, " ".join(words)))
        labels.append((k, None, toxic))
    rows += ODD_ROWS[:2] + [(2000, None), (2001, "")]
    labels += [(0, None, None), (None, None, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame(rows), table).collect()
    assert len(got) == len(rows)
    truth = {k: t for k, _, t in labels[:900]}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
               for x in got if x.doc_id is not None)
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)


def test_no_labels_and_no_rows(spark, frame):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x.score for x in toxicity.toxicity(frame(ODD_ROWS), none).collect()} == {0.0}
    assert toxicity.toxicity(frame([]), none).count() == 0


# -- fingerprints ----------------------------------------------------------------------------

def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    return ({tuple(words[i:i + 5]) for i in range(len(words) - 4)}
            if len(words) >= 5 else {tuple(words)} - {()})


def test_fingerprints_follow_the_next_document(spark, frame, prose):
    rows = [(k * 3, prose(k, k * 7 % 300)) for k in range(150)] + [(1, "ü" * 9), (2, None)]
    got = {x.doc_id: x for x in minhash.fingerprints(frame(rows)).collect()}
    assert len(got) == len(rows)
    chain = sorted(rows, reverse=True, key=lambda x: x[0])
    errors = []
    for k, (doc, text) in enumerate(chain):
        text, after = text or "", chain[(k + 1) % len(chain)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        x = got[doc]
        assert x.n_chars == len(text)
        assert x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        if len(a | b) > 20:
            errors.append(x.near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_fingerprint_rows(frame, prose):
    for rows in (ODD_ROWS, [(5, "a b c")], [(5, "")]):
        got = minhash.fingerprints(frame(rows)).collect()
        assert sorted(-1 if x.doc_id is None else x.doc_id for x in got) == sorted(
            -1 if d is None else d for d, _ in rows)
    assert minhash.fingerprints(frame([])).count() == 0
    same = minhash.fingerprints(frame([(1, prose(1, 90)), (2, prose(1, 90).upper())])).collect()
    assert same[0].fingerprint == same[1].fingerprint and same[0].near_next == 1.0


def test_bias_correction():
    r = random.Random(1)
    words = [f"w{k}" for k in range(4000)]
    for share in (0.0, 0.3, 0.6, 0.9):
        errors = []
        for _ in range(30):
            a = r.sample(words, 400)
            b = a[:int(400 * share)] + r.sample(words, 400 - int(400 * share))
            x, y = minhash.signatures([" ".join(a).encode(), " ".join(b).encode()])
            near = minhash.likeness((x[:1], y[:1]), (x[1:], y[1:]))[0]
            s, t = shingles(" ".join(a)), shingles(" ".join(b))
            errors.append(near - len(s & t) / len(s | t))
        assert abs(np.mean(errors)) < 0.015


# -- source mix ------------------------------------------------------------------------------

def plain_targets(sizes):
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    budget, target, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = budget / sum(weights[k] for k in open_)
        over = {k for k in open_ if level * weights[k] > 2 * sizes[k]}
        for k in over or open_:
            target[k] = 2.0 * sizes[k] if over else level * weights[k]
            budget -= target[k] if over else 0
        open_ = open_ - over if over else set()
    return target


@pytest.fixture()
def mixed(spark, prose):
    r = random.Random(9)
    rows = [(k, prose(k, r.randint(0, 60)) + r.choice(["", " ### $$$"]),
             r.choice(["a"] * 30 + ["b", "c", "Z", None, "é"])) for k in range(1500)]
    rows += [(None, "x y", "a"), (7000, None, "only null"), (7001, "one two", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string") \
        .repartition(5)


def test_mix_reaches_targets(mixed, monkeypatch):
    monkeypatch.setattr(mixture, "RANGE_ROWS", 40)
    rows, docs = mixed
    got = mixture.mixture(docs).collect()
    assert len(got) == len(rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    size = {n: sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names}
    want = dict(zip(names, plain_targets([size[n] for n in names])))
    source = {d: s for d, _, s in rows}
    for name in names:
        mine = [x for x in got if source[x.doc_id] == name]
        assert all(x.source_size == size[name] for x in mine)
        assert all(abs(x.target - want[name]) < 1e-6 for x in mine)
        assert abs(sum(x.taken for x in mine) - want[name]) <= 40
        assert all(x.taken <= 2 * x.size for x in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixture.mixture(docs.repartition(2)).collect()))
    taken = sorted(x.doc_id or -1 for x in got for _ in range(x.copies) if x.size)
    out = mixture.mix(docs)
    assert sorted(x.doc_id or -1 for x in out.collect()) == taken and out.columns == docs.columns


def test_mix_without_words(frame):
    assert mixture.mixture(frame([])).count() == 0
    got = mixture.mixture(frame([(1, None), (2, " ")])).collect()
    assert [(x.size, x.target, x.taken) for x in got] == [(0, 0.0, 0)] * 2
