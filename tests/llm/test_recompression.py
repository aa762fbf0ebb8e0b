"""Removed words against direct counting of windows."""
from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from licmatch.llm import recompression, words as W
from tests_llm_rows import ODD_ROWS


def brute(rows, width):
    big = 2**63 - 1
    split = [(big if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for doc, words in split:
        for i in range(len(words) - width + 1):
            key = tuple(words[i:i + width])
            least[key] = min(least.get(key, big), doc)
    out = []
    for doc, words in split:
        gone = set()
        for i in range(len(words) - width + 1):
            if least[tuple(words[i:i + width])] < doc:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((-1 if doc == big else doc, len(words), len(gone),
                    hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
                  for r in df.collect())


def test_equal_windows_have_equal_anchors():
    r = random.Random(3)
    for letters in (2, 3, 50):
        pool = [f"w{k}" for k in range(letters)]
        texts = [" ".join(r.choices(pool, k=r.randint(0, 120))) for _ in range(60)]
        passage = " ".join(r.choices(pool, k=20))
        texts += [" ".join(r.choices(pool, k=5) + [passage] + r.choices(pool, k=5))
                  for _ in range(20)]
        data = "".join(texts).encode()
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        words = W.hash_words(np.frombuffer(data, dtype=np.uint8), offsets)
        starts, anchors = recompression.window_anchors(words, 13)
        flat = [w for t in texts for w in t.split()]
        seen = {}
        for at, name in zip(starts.tolist(), anchors.tolist()):
            assert seen.setdefault(tuple(flat[at:at + 13]), name) == name


def test_removal_equals_brute_force(frame, prose):
    r = random.Random(8)
    texts = [prose(k, 30 + k) for k in range(40)]
    passages = [prose(500 + k, r.randint(12, 60)) for k in range(12)]
    for k in range(60):
        texts.append(" ".join([prose(900 + k, r.randint(0, 9)), r.choice(passages),
                               prose(1900 + k, r.randint(0, 9)), r.choice(passages)]))
    texts += ["ab " * n + "cd " * m for n in (3, 9, 20, 40) for m in (4, 10, 30)]
    texts += [" ".join(["x", "y"] * n) for n in (6, 7, 15, 40)]
    texts += texts[30:60] + [t.replace(" ", "\n ") for t in texts[60:70]]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    assert result(recompression.substring_dedup(frame(rows))) == brute(rows, 13)


def test_many_copies_of_a_passage(frame, prose):
    passage = prose(1, 30)
    rows = [(k, f"{prose(k, 8)} {passage} {prose(k + 5000, 8)}") for k in range(500)]
    assert result(recompression.substring_dedup(frame(rows))) == brute(rows, 13)


def test_odd_rows(frame, prose):
    rows = ODD_ROWS + [(9, prose(1, 50)), (9, prose(2, 50)), (9, prose(2, 50)), (8, prose(2, 50)),
                       (None, prose(1, 20)), (None, prose(1, 50)), (12, prose(1, 13))]
    assert result(recompression.substring_dedup(frame(rows))) == brute(rows, 13)
    assert recompression.substring_dedup(frame([])).count() == 0


def test_kept_text(frame, prose):
    rows = [(1, prose(1, 30)), (2, "a  b\n" + prose(1, 30) + " c")]
    got = {r.doc_id: r.kept for r in recompression.substring_dedup(frame(rows)).collect()}
    assert got == {1: None, 2: "a b c"}
