"""Periodic runs against a search of every period."""
from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from licmatch.llm.periodic_runs import MIN_LENGTH, find_runs, periodic_runs
from tests_llm_rows import ODD_ROWS


def every_run(words):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(MIN_LENGTH, 2 * q) and j > i:
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def sequences():
    r = random.Random(5)
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    yield b
    for n in (0, 1, 11, 12, 300):
        yield [7] * n
    for _ in range(150):
        yield [r.randrange(2) for _ in range(r.randrange(200))]
        mixed = []
        while len(mixed) < r.randrange(300):
            period = [r.randrange(3) for _ in range(r.randrange(1, 60))]
            mixed += (period * r.randrange(1, 6))[:r.randrange(1, 200)]
        yield mixed
        # highly periodic regions that repeat at a distance, and that touch
        stretch = [0, 1] * r.randrange(1, 40) + [0] * r.randrange(3)
        yield (stretch * r.randrange(1, 6) + [r.randrange(3)]) * r.randrange(1, 4)
        plain = [r.randrange(1000) for _ in range(r.randrange(1, 90))]
        yield plain + plain[r.randrange(len(plain)):] * r.randrange(1, 5) + plain


@pytest.mark.parametrize("part", range(5))
def test_runs_equal_every_run(part):
    for i, words in enumerate(sequences()):
        if i % 5 == part:
            got = [tuple(run) for run in find_runs(np.array(words, dtype=np.int64)).tolist()]
            assert got == every_run(words), words


def expected(doc_id, text, planted):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if planted and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = every_run(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3),
            1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("planted", [False, True])
def test_table(frame, prose, planted):
    rows = ODD_ROWS + [(i, prose(i, 10 + 7 * i)) for i in range(20, 60)]
    rows += [(70, "ab " * 50), (71, ("x y z " + prose(3, 40) + "\n") * 4), (72, "z" * 100_000),
             (73, " ".join(["long"] * 60_000)), (-5, prose(9, 300) * 2)]
    got = sorted(map(tuple, periodic_runs(frame(rows), planted).collect()), key=str)
    want = sorted((expected(i, t, planted) for i, t in rows if i != 73), key=str)
    assert [r for r in got if r[0] != 73] == want
    same = [r for r in got if r[0] == 73][0]
    assert same[1] >= 1 and same[3] >= (60_000 if not planted else 1)


def test_empty_table(frame):
    assert periodic_runs(frame([(1, "a")]).limit(0)).count() == 0
