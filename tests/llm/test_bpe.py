"""Token ids against the tokenizer library, and the round trip."""
from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from licmatch.llm import bpe
from tests_llm_rows import ODD_ROWS


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe.default_path())


def odd_texts():
    r = random.Random(1)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(chars), 700):
        some = chars[lo:lo + 700]
        yield "".join(some)
        yield "".join(f" {c} {c}x1{c}!" for c in some)
    bits = ["<|endoftext|>", " ", "a", "é", "'ll", "\n", "  ", "\u0085", "\x1c", "zz", "1", "!"]
    for _ in range(500):
        yield "".join(r.choices(bits, k=50))
    for letters in ("ab", "abcdefghijklmnop"):
        for _ in range(700):
            yield "".join(r.choices(letters, k=r.randint(1, 60)))
    yield from (c * n for c in "a \n1-" for n in (1, 2, 3, 7, 64, 500))


def test_ids_equal_the_library(reference):
    own, texts = bpe.load(bpe.default_path()), list(odd_texts())
    ids = [x for g in bpe._groups(texts) for x in own.encode_batch(g)]
    for text, got, want in zip(texts, ids, reference.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text
        assert own.decode(got) == text.encode()


def test_guess_check_and_exact_merging_agree():
    own, r = bpe.load(bpe.default_path()), random.Random(4)
    tokens = np.array(r.choices(list(own.whole.values()), k=4000))
    fine = own.compatible(tokens[:-1], tokens[1:])
    for a, b, ok in zip(tokens[:-1].tolist(), tokens[1:].tolist(), fine.tolist()):
        assert (own.merge(own.bytes[a] + own.bytes[b]) == [a, b]) == ok


def test_heap_merging_equals_plain_merging(monkeypatch):
    own, r = bpe.load(bpe.default_path()), random.Random(6)
    words = ["".join(r.choices("abcde st", k=150)).encode() for _ in range(40)] + [b"a" * 190]
    plain = [own.merge(w) for w in words]
    monkeypatch.setattr(bpe, "LONG", 0)
    assert [own.merge(w) for w in words] == plain


def test_rows(frame, reference, prose):
    rows = ODD_ROWS + [(40, "x" * 50000), (41, prose(1, 20000)), (42, "<|endoftext|> a")]
    got = bpe.encode(frame(rows), ["doc_id"]).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if d is None else d, hashlib.sha256(np.array(
        reference.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest(),
        hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_sha256, r.decoded_sha256)
                  for r in got) == want
    assert all(len(r.ids) == r.n_tokens for r in got)
    back = bpe.decode(bpe.encode(frame(rows), ["doc_id"])).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in rows)
    assert bpe.encode(frame([]), ["doc_id"]).count() == 0


def test_many_words_merged_at_once_equal_plain_merging(monkeypatch):
    own, r = bpe.load(bpe.default_path()), random.Random(8)
    words = [bytes(r.choices(b" aabcdeest\xc3\xa9", k=r.randint(1, 60))) for _ in range(600)]
    words += [b"a" * k for k in range(1, 45)] + [t for t in own.bytes[:600] if t]
    plain = [own.merge(w) for w in words]
    calls = []
    monkeypatch.setattr(own, "merge", lambda w, one=own.merge: calls.append(w) or one(w))
    assert own.merge_many(words) == plain and own.merge_many([]) == []
    assert all(len(w) > bpe.WIDTHS[-1] for w in calls)


def test_words_cut_together_equal_words_cut_alone():
    own, r = bpe.load(bpe.default_path()), random.Random(9)
    bits = ["a", "é", "'ll", "'", "\n", "\u0085", "\x1c", "　", "1", "!", "中", "x\n", "_", "²"]
    words = [w for _ in range(3000) if not (w := "".join(r.choices(bits, k=r.randint(1, 6))))[0]
             .isspace()]
    alone = [own.pretokens(" " + w) for w in words]
    assert own._words(words) == alone and own._words([]) == []
