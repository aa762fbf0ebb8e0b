"""The join against brute force: sets, links and components of every pair."""
from __future__ import annotations

import random
import re

from licmatch.llm import ngram_join
from tests_llm_rows import ODD_ROWS


def brute(rows, n=5, percent=75):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
        sets.append(grams if len(words) >= n else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = rows[i][0] == rows[j][0] and a and b
            if same_id or (a and b and 100 * len(a & b) >= percent * len(a | b)):
                parent[find(i)] = find(j)
    big = 2**63 - 1
    low = {}
    for i, (doc, _) in enumerate(rows):
        doc = big if doc is None else doc
        low[find(i)] = min(low.get(find(i), big), doc)
    return sorted((-1 if d is None else d, len(sets[i]), -1 if low[find(i)] == big else low[find(i)])
                  for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles,
                   -1 if r.component_id is None else r.component_id) for r in df.collect())


def near_copies(prose, seed, count, words, edits):
    base = prose(seed, words).split()
    out = []
    for k in range(count):
        r, copy = random.Random(seed * 1000 + k), list(base)
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_join_equals_brute_force(frame, prose):
    texts = [prose(k, 20 + 7 * k) for k in range(40)]
    for seed in range(100, 108):
        texts += near_copies(prose, seed, 12, 90, 6)
    passage = prose(999, 60)
    texts += [passage + " " + prose(2000 + k, 5 + 4 * k) for k in range(30)]
    texts += texts[:10] + [t.upper() for t in texts[40:44]]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    assert result(ngram_join.ngram_join(frame(rows))) == brute(rows)


def test_large_family_of_near_copies(frame, prose):
    rows = list(enumerate(near_copies(prose, 7, 400, 60, 3) + [prose(k, 60) for k in range(50)]))
    assert result(ngram_join.ngram_join(frame(rows))) == brute(rows)


def test_odd_rows_and_empty_table(frame):
    assert result(ngram_join.ngram_join(frame(ODD_ROWS))) == brute(ODD_ROWS)
    assert ngram_join.ngram_join(frame([])).count() == 0


def test_keep_one(frame, prose):
    rows = [(5, prose(1, 50)), (2, prose(1, 50)), (9, prose(2, 50)), (9, prose(2, 50)), (None, "")]
    kept = ngram_join.keep_one(frame(rows))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 9]
    assert kept.columns == frame(rows).columns


def test_long_text(frame, prose):
    long = prose(3, 30000)
    rows = [(1, long), (2, long + " tail"), (3, "x" * 300000), (4, "x" * 300000)]
    assert [r[2] for r in result(ngram_join.ngram_join(frame(rows)))] == [1, 1, 3, 3]


def test_keep_one_keeps_texts_that_share_or_lack_an_id(frame, prose):
    third, far = prose(1, 60), prose(2, 60)
    rows = [(3, third), (900, far), (None, third + " tail"), (None, far + " tail"),
            (None, prose(4, 60)), (None, prose(5, 60)), (None, prose(5, 60)),
            (7, prose(6, 60)), (7, prose(7, 60)), (7, prose(7, 60) + " tail"),
            (8, ""), (8, ""), (None, None), (None, " \n")]
    kept = ngram_join.keep_one(frame(rows))
    want = [(3, third), (900, far), (None, prose(4, 60)), (None, prose(5, 60)),
            (7, prose(6, 60)), (7, prose(7, 60)), (8, ""), (8, ""), (None, None), (None, " \n")]
    order = lambda r: (r[0] or -1, r[1] or "", r[1] is None)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=order) == \
        sorted(want, key=order)


def brute_links(rows, n=5, percent=75):
    """Per row the number of other rows it links with, over all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words
                    else set())
    return sorted((-1 if d is None else d, sum(
        i != j and bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
        for j, b in enumerate(sets))) for i, ((d, _), a) in enumerate(zip(rows, sets)))


def links(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_links) for r in df.collect())


def test_number_of_links_equals_all_pairs(frame, prose, monkeypatch):
    """Links inside a component count too, over blocks of it; copies count as often as they come."""
    monkeypatch.setattr(ngram_join, "TREE_SETS", 16)
    texts = near_copies(prose, 7, 60, 60, 4) + near_copies(prose, 8, 40, 200, 9)
    texts += [prose(k, 60) for k in range(30)] + texts[:25] + [" ".join(texts[0].split()[:52])]
    rows = list(enumerate(texts)) + [(3, prose(50, 40)), (3, prose(50, 40) + " end"), (None, None)]
    rows += [(None, texts[0]), (900, "one"), (901, "one"), (902, ""), (903, "")]
    random.Random(6).shuffle(rows)
    want = brute_links(rows)
    assert len({x for _, x in want}) > 15
    assert links(ngram_join.ngram_join(frame(rows))) == want
    assert links(ngram_join.ngram_join(frame(ODD_ROWS))) == brute_links(ODD_ROWS)


def test_texts_of_mostly_common_grams(frame, prose):
    """Passages that many texts share fill the first grams of texts that link with none."""
    r, passages = random.Random(9), [prose(700 + k, 40) for k in range(6)]
    texts = [" ".join(r.sample(passages, 3)) + " " + prose(800 + k, 5 + k) for k in range(60)]
    texts += [" ".join(t.split()[:-3]) for t in texts[::4]] + [t + " " + t for t in texts[::9]]
    rows = list(enumerate(texts))
    got = ngram_join.ngram_join(frame(rows))
    assert result(got) == brute(rows) and links(got) == brute_links(rows)


def test_texts_that_cannot_link_are_not_compared(frame, prose, monkeypatch):
    passage = prose(1, 30)
    rows = [(k, prose(100 + k, 90) + " " + passage) for k in range(40)]
    rows += [(50, prose(2, 80)), (51, prose(2, 80) + " end")]
    nodes, of = [], ngram_join.meeting_grams
    monkeypatch.setattr(ngram_join, "meeting_grams", lambda sets, percent: nodes.extend(
        x.node for x in sets.select("node").collect()) or of(sets, percent))
    assert links(ngram_join.ngram_join(frame(rows))) == brute_links(rows)
    assert sorted(nodes) == [50, 51]


def test_pairs_that_meet_too_late_are_not_compared(frame, prose, monkeypatch):
    """A family whose members are far from each other: its pairs meet, and few are compared."""
    words, r = prose(5, 100).split(), random.Random(3)
    drawn = [sorted(r.sample(range(0, 100, 5), 4)) for _ in range(40)]
    # Changed words are the same in several texts, so hardly a gram is one text's own.
    texts = [" ".join(f"y{i}" if i in at else w for i, w in enumerate(words)) for at in drawn]
    rows = list(enumerate(dict.fromkeys(texts)))
    kept, of = [], ngram_join.meeting_early
    monkeypatch.setattr(ngram_join, "meeting_early", lambda met, percent: (
        kept.append((met.toDF("gram", "a", "n", "m", "at", "of_a").join(
            met.toDF("gram", "b", "n", "m", "at", "of_b"), "gram").where("a < b and of_a <> of_b")
            .select("a", "b").distinct().count(), of(met, percent).count())), of(met, percent))[1])
    got = ngram_join.ngram_join(frame(rows))
    assert result(got) == brute(rows) and links(got) == brute_links(rows)
    met, compared = kept[0]
    assert 3 * compared <= 2 * met and met > 200
