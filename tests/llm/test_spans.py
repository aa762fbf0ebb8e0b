"""Personal data and secrets: base spans against plain regular expressions."""
from __future__ import annotations

import hashlib
import random
import re
import tempfile

import numpy as np

from licmatch.llm import pii, secret_ledger
from tests_llm_rows import ODD_ROWS


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]
SECRET = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
               r"""([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]


def brute(text, rules):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(rules)
             for m in re.finditer(p, text, re.ASCII) if ok(m)]
    names = [r[0] for r in rules]
    joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found))
    return (*[sum(k == j for _, j, _ in found) for k in range(len(rules))],
            hashlib.sha256(joined.encode()).hexdigest()), joined


def texts(seed, bits, count=400):
    r = random.Random(seed)
    for _ in range(count):
        yield "".join(r.choice(bits) for _ in range(r.randint(0, 30)))


def check(got, rows, rules, columns):
    got = {r.doc_id: r for r in got}
    for doc, text in rows:
        want, joined = brute(text or "", rules)
        assert tuple(got[doc][c] for c in columns) == want, (text, got[doc], joined)
        assert set(filter(None, joined.split(","))) <= set(got[doc].spans.split(","))


PERSON_BITS = ["jo", ".", "@", "mail", "-", "com", " ", " ", "é😀", "_", "%", "+", "1", "25", "300",
               "\u0001", "192.168.0.1", "4539 1488 0343 6467", "4111111111111111", "(", ")", "\n",
               "+1 (555) 010-2345", "a@b.co", "call ", "12345678901234", "10.0.0.256", "x"]
SECRET_BITS = ["password", "PassWord", "token", "api_key", "APIKEY", "secret", "K", '"', "'",
               " ", "=", ":", "abc123", "x", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef",
               "\n", "é", "\u0001", "f", "-----BEGIN RSA PRIVATE KEY-----"]


def test_personal_data_base_spans(frame):
    rows = list(enumerate(texts(1, PERSON_BITS)))
    got = pii.personal_data(frame(rows)).collect()
    check(got, rows, PERSONAL, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"])


def test_secret_base_spans(frame):
    rows = list(enumerate(texts(2, SECRET_BITS)))
    got = secret_ledger.secrets(frame(rows)).collect()
    check(got, rows, SECRET, ["n_assign", "n_access", "n_hex", "base_sha256"])
    assert any("pem:" in r.spans for r in got)


def test_odd_rows_and_long_texts(frame):
    rows = [(k, t) for k, (_, t) in enumerate(ODD_ROWS)]
    rows += [(50, "a" * 20000), (51, "1" * 20000), (52, "1." * 20000), (53, "+1" * 30000),
             (54, "jo@" * 20000), (55, "f" * 50000), (56, "jo@a.co " * 1500), (57, "1 " * 30000)]
    check(pii.personal_data(frame(rows)).collect(), rows, PERSONAL,
          ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"])
    check(secret_ledger.secrets(frame(rows)).collect(), rows, SECRET,
          ["n_assign", "n_access", "n_hex", "base_sha256"])
    for operator in (pii.personal_data, secret_ledger.secrets):
        assert operator(frame(ODD_ROWS)).count() == len(ODD_ROWS)
        assert operator(frame([])).count() == 0


def test_long_key_header(frame):
    """A header of thousands of words, which a recursive pattern would overflow on."""
    rows = [(1, "-----BEGIN " + "A " * 20_000 + "PRIVATE KEY-----"),
            (2, "-----BEGIN PRIVATE KEY-----"), (3, "-----BEGIN " + "B " * 20_000),
            (4, "x -----BEGIN RSA PRIVATE KEY----- y"), (5, "-----BEGIN XPRIVATE KEY-----")]
    got = {r.doc_id: r.spans for r in secret_ledger.secrets(frame(rows)).collect()}
    assert got == {1: f"pem:0:{11 + 40_000 + 16}", 2: "pem:0:27", 3: "", 4: "pem:2:33", 5: ""}


def test_many_matches_in_one_text(frame):
    """The time follows the number of matches, not its square."""
    rows = [(1, "jo@a.co " * 40_000), (2, "token=abcdef1 " * 30_000)]
    found = pii.personal_data(frame(rows)).collect()
    assert {r.doc_id: r.n_email for r in found} == {1: 40_000, 2: 0}
    spans = {r.doc_id: r.spans for r in found}[1].split(",")
    assert spans[0] == "email:0:7" and spans[-1] == f"email:{8 * 39_999}:{8 * 39_999 + 7}"
    found = secret_ledger.secrets(frame(rows)).collect()
    assert {r.doc_id: r.n_assign for r in found} == {1: 0, 2: 30_000}


def test_ledger_with_a_blob_twice(spark, frame):
    ledger = tempfile.mkdtemp(prefix="licmatch-test-") + "/ledger"
    rows = [(1, "token = abcdef1"), (2, "plain")]
    secret_ledger.secrets(frame(rows), ledger).collect()
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "-copy")
    spark.read.parquet(ledger + "-copy").write.mode("append").parquet(ledger)
    got = secret_ledger.secrets(frame(rows), ledger).collect()
    assert {r.doc_id: r.n_assign for r in got} == {1: 1, 2: 0} and len(got) == 2


def test_estimates_recover_reliabilities():
    r = np.random.default_rng(5)
    truth = r.random(20000) < 0.4
    good = [0.95, 0.8, 0.75, 0.7, 0.6]
    cast = np.stack([np.where(r.random(20000) < g, truth, ~truth) * 2 - 1 for g in good], axis=1)
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    likely, chance = pii.estimate(patterns, counts.astype(float))
    assert np.allclose(chance[1, :, 2], good, atol=0.05)
    right = sum(((truth == (p > 0.5)) & (cast == row).all(axis=1)).sum()
                for row, p in zip(patterns, likely))
    assert right / 20000 > 0.94


def test_ledger_scans_unseen_blobs_only(spark, frame, monkeypatch):
    ledger = tempfile.mkdtemp(prefix="licmatch-test-") + "/ledger"
    first = [(1, "token = abcdef1"), (2, "token = abcdef1"), (3, "plain")]
    secret_ledger.secrets(frame(first), ledger).collect()
    assert spark.read.parquet(ledger).count() == 2
    got = secret_ledger.secrets(frame(first + [(4, "secret: zzzzzz9"), (5, "plain")]), ledger)
    assert {r.doc_id: r.n_assign for r in got.collect()} == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}
    assert spark.read.parquet(ledger).count() == 3
    monkeypatch.setattr(secret_ledger, "rules_version", lambda: "other")
    assert secret_ledger.secrets(frame(first), ledger).count() == 3
    assert spark.read.parquet(ledger).count() == 5
