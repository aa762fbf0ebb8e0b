"""Clusters against the same rounds in plain whole numbers."""
from __future__ import annotations

import hashlib
import math
import random

import duckdb
import pytest

from licmatch.llm import centroids


def plain(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64
            and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept
                   if i is not None)
    centers = [v for _, v in seeds[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, members in groups.items():
            centers[k] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = {}
    for _, d, k in found:
        sums[k] = sums.get(k, 0) + d
    return [(i, k, d, sums[k], sum(sums.values()),
             hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest())
            for i, d, k in found]


def vectors(n=90, scale=1.0, seed=3):
    r = random.Random(seed)
    return [(i, [r.uniform(-scale, scale) for _ in range(64)]) for i in range(n)]


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, "x", 2.5) for i, v in rows],
                                 f"vec_id long, embedding array<{kind}>, label int, "
                                 "vector string, distance double").repartition(3)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("scale", [0.01, 1.0, 1000.0, 1e6, 1e9])
def test_equals_plain_rounds(spark, scale):
    rows = vectors(scale=scale)
    want = [(i, k, *[x if x < 2**63 else None for x in (d, s, t)], h)
            for i, k, d, s, t, h in plain(rows)]
    assert result(centroids.cluster(table(spark, rows))) == sorted(want, key=str)


def test_odd_vectors(spark):
    rows = vectors(30)
    rows += [rows[0], rows[0], (5, rows[9][1]), (None, rows[2][1]), (100, None), (101, []),
             (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63),
             (105, [float("nan")] * 64), (106, [float("inf")] + [0.0] * 63),
             (107, [0.0] * 64), (108, [-0.0] * 64), (-3, rows[3][1])]
    assert result(centroids.cluster(table(spark, rows))) == sorted(plain(rows), key=str)


def test_float_vectors_few_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert result(centroids.cluster(table(spark, rows, "float"))) == sorted(plain(rows), key=str)
    assert centroids.cluster(table(spark, [(1, None)])).count() == 0
    assert centroids.cluster(table(spark, [(None, [1.0] * 64)])).count() == 0


def test_immense_components_are_not_kept(spark):
    rows = vectors(20) + [(50, [1e300] + [0.0] * 63)]
    got = result(centroids.cluster(table(spark, rows)))
    assert got == sorted(plain(rows[:-1]), key=str)


def test_oracle_statement(spark):
    sf = "/root/testdata/sf0.001"
    own = duckdb.connect()
    own.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{sf}/embeddings.parquet')")
    want = sorted(map(tuple, own.execute(centroids.ORACLE).fetchall()), key=str)
    assert result(centroids.cluster(spark.read.parquet(f"{sf}/embeddings.parquet"))) == want
