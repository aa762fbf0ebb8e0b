"""Suffix-array measures against direct counting."""
from __future__ import annotations

import random
import re

import numpy as np

from licmatch.llm import repetition
from tests_llm_rows import ODD_ROWS


def brute(text, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    three, spans = set(), set()
    for i, k in enumerate(longest):
        if k >= 3:
            three.update(range(i, i + 3))
        if k >= least:
            spans.update(range(i, i + k))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(three), len(spans), max(longest, default=0))


def test_measures_equal_brute_force():
    r = random.Random(1)
    for k in range(150):
        words = [r.choice("ab cé d# e|".split()[: 2 + k % 3]) for _ in range(r.randint(0, 60))]
        text = "".join(w + r.choice([" ", "\n", "  ", "\t", "\x85"]) for w in words)
        assert repetition.measure(text, 5) == brute(text, 5), text


def test_periodic_text():
    longest = repetition.repeats(np.zeros(5000, dtype=np.int64))
    assert longest[0] == 4999 and longest[-1] == 1


def test_table_rows(frame, prose):
    rows = ODD_ROWS + [(20, prose(1, 200)), (21, prose(2, 40)), (22, (prose(3, 30) + " ") * 8),
                       (23, prose(4, 200) + "\n" + prose(5, 90) + "\n" + prose(5, 90))]
    got = {r.doc_id: r for r in repetition.quality_table(frame(rows)).collect()}
    assert repetition.quality_table(frame(rows)).count() == len(rows)
    assert got[20].kept and not got[20].base_failed
    assert got[21].base_failed and not got[21].kept
    assert got[22].base_failed and not got[22].kept
    assert not got[23].base_failed and not got[23].kept
    assert got[1].n_words == 0 and got[1].base_failed
    kept = repetition.keep_quality(frame(rows))
    assert [r.doc_id for r in kept.collect()] == [20] and kept.columns == frame(rows).columns
    assert repetition.quality_table(frame([])).count() == 0
