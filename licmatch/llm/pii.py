"""Personal data by weak supervision.

Candidates are all matches of the four base patterns, those that fail the base checks too.
Labelers vote on each: the format check, a cue word beside it, a gazetteer (endings, address
ranges, issuer digits, country codes), how it is set off from the text, and how varied it is.
Expectation maximisation over the counts of vote patterns estimates, per kind, how reliable
every labeler is and how likely each pattern is personal data; a logistic span classifier with
span length as a further feature is trained on these likelihoods. Spans that pass the base
checks always stay; a failing candidate is added if the classifier says so.

All work on texts and candidates is DataFrame expressions; only the counts of vote patterns (at
most 4 * 3**5 * 4 rows, whatever the corpus) come to the driver, where the estimates are made.

Defined cases: null text is empty and has no spans; every row gives one row; places count code
points.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from licmatch.llm.frames import stage
from licmatch.llm.spans import count_of, listed, none, pieces, spans

KINDS = ["email", "ip", "card", "phone"]
#: Fixed patterns, written so that they cannot backtrack: a match begins where a run of its
#: first characters begins or where the last match ended.
PATTERNS = [
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    (r"[0-9](?:[\x20-]?[0-9]){13,}+", None),
    (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
]
CONTEXT = 24
LABELERS, EM_ROUNDS = 5, 60

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CUES = ["mail|contact|write|reach", "ip|host|server|address|addr", "card|visa|pay|account|credit",
         "phone|tel|call|fax|mobile|dial"]
#: Gazetteers as patterns over the match: endings in use, unassigned or local addresses,
#: issuer digits, country codes.
_ENDINGS = r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|it|nl)$"
_LOCAL = r"^0*(?:0|10|127|169|192|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
_ISSUER = r"^[3-6]"
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Check sum of a text of digits: from the right, every second digit is doubled."""
    value = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)), F.lit(0),
        lambda total, k: total + F.pmod(
            F.substring(digits, F.char_length(digits) - k + 1, F.lit(1)).cast("int")
            * (F.lit(2) - k % 2)
            - F.when((k % 2 == 0) & (F.substring(digits, F.char_length(digits) - k + 1, F.lit(1))
                                     >= "5"), 9).otherwise(0), F.lit(10)))
    return value % 10 == 0


def passes(kind: int, body: Column) -> Column:
    """The base check of a match."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return body.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    size = F.char_length(_digits(body))
    if kind == 2:
        # A number of any length may match; only those of a card's length are summed.
        return F.when(size.between(14, 19), luhn(_digits(body))).otherwise(False)
    return size.between(10, 15)


def votes(kind: int, s: Column) -> list[Column]:
    """1, -1 or 0 (abstains) of each labeler; the first is the base check."""
    body = s["body"]
    gazetteer = [body.rlike(_ENDINGS), ~body.rlike(_LOCAL), body.rlike(_ISSUER),
                 body.rlike(_COUNTRY)][kind]
    beside = F.lower(F.concat_ws(" ", s["left"], s["right"]))
    apart = ~s["left"].rlike(r"[\p{L}\p{N}]$") & ~s["right"].rlike(r"^[\p{L}\p{N}]")
    varied = F.size(F.array_distinct(F.split(body, ""))) >= 5
    sign = lambda c: F.when(c, 1).otherwise(-1)
    return [sign(passes(kind, body)),
            F.when(beside.rlike(rf"\b(?:{_CUES[kind]})"), 1).otherwise(0),
            sign(gazetteer), sign(apart), sign(varied)]


def _judge(kind: int):
    return lambda s: F.struct(
        s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"),
        F.least(F.floor((s["end"] - s["start"]) / 8), F.lit(3)).cast("int").alias("length"),
        F.array(*votes(kind, s)).alias("votes"))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): array of (start, kind, end, body length class, votes)."""
    cut = docs.select("doc_id", *[pieces("text", p, needs).alias(f"cut{k}")
                                  for k, (p, needs) in enumerate(PATTERNS)])
    judged = [F.transform(spans(f"cut{k}", k, CONTEXT), _judge(k)) for k in range(len(KINDS))]
    return cut.select("doc_id", F.concat(*judged).alias("found"))


# -- estimates, over counts of vote patterns --------------------------------------------------

def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS):
    """(likelihood per pattern, reliabilities) by expectation maximisation for two classes.

    ``patterns`` has a row per distinct vote pattern. Reliabilities are, per class and labeler,
    the chances of -1, 0 and 1. The start is the share of positive votes.
    """
    cast = np.maximum((patterns != 0).sum(axis=1), 1)
    likely = np.clip((patterns == 1).sum(axis=1) / cast, 0.05, 0.95)
    chance = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([(1 - likely) * counts, likely * counts])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        for value in (-1, 0, 1):
            chance[:, :, value + 1] = weight @ (patterns == value) + 1
        chance /= chance.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + np.stack([
            sum(np.log(chance[c, j, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
            for c in (0, 1)])
        likely = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return likely, chance


def classifier(features: np.ndarray, likely: np.ndarray, counts: np.ndarray,
               steps: int = 400) -> np.ndarray:
    """Weights (intercept last) of a logistic model fitted to likelihoods."""
    x = np.hstack([features, np.ones((len(features), 1))])
    share, w = counts / max(counts.sum(), 1), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (share * (p - likely)) + 1e-4 * w)
    return w


def train(found: DataFrame) -> dict[int, list[float]]:
    """Per kind the weights of the votes, of the length class and of the intercept."""
    rows = (found.select(F.explode("found").alias("s"))
            .groupBy("s.kind", "s.votes", "s.length").count().collect())
    models = {}
    for kind in range(len(KINDS)):
        mine = [r for r in rows if r["kind"] == kind]
        if mine:
            order = sorted(mine, key=lambda r: (r["votes"], r["length"]))
            patterns = np.array([r["votes"] for r in order])
            counts = np.array([r["count"] for r in order], dtype=float)
            likely, _ = estimate(patterns, counts)
            features = np.hstack([patterns, np.array([[r["length"]] for r in order]) / 3])
            models[kind] = classifier(features, likely, counts).tolist()
    return models


def _score(s: Column, models: dict[int, list[float]]) -> Column:
    """Log odds of the span classifier."""
    out = F.lit(-math.inf)
    for kind, w in models.items():
        terms = [w[j] * F.element_at(s["votes"], j + 1) for j in range(LABELERS)]
        total = sum(terms, F.lit(w[-1])) + w[-2] * s["length"] / 3
        out = F.when(s["kind"] == kind, total).otherwise(out)
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    found = stage(candidates(texts))
    models = train(found)
    base = F.filter("found", lambda s: F.element_at(s["votes"], 1) == 1)
    every = F.filter("found", lambda s: (F.element_at(s["votes"], 1) == 1)
                     | (_score(s, models) > 0))
    return (found.withColumns({"base": base, "every": every}).select(
        "doc_id", *[count_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        listed(F.col("every"), KINDS).alias("spans")))
