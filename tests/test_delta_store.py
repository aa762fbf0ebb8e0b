"""The store that merges on read, against plain dictionaries."""
import os
import random

import pytest
from pyspark.sql import functions as F

from licmatch.schema import D, L, S, struct
from licmatch.sources.delta_store import DeltaStore, VersionTaken

COLUMNS = struct(("id", S), ("a", S), ("n", D), ("ord", L))


def table(spark, folder, buckets=4):
    return DeltaStore(spark, f"{folder}/t", COLUMNS, buckets=buckets)


def rows_of(frame):
    return {r["id"]: (r["a"], r["n"], r["ord"]) for r in frame.collect()}


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id string, a string, n double, ord bigint")


def patches(spark, *values):
    return spark.createDataFrame(list(values), "id string, field string, value string, ord int")


def test_batches_equal_a_dictionary(spark, folder):
    rng, store, want = random.Random(1), table(spark, folder), {}
    for step in range(6):
        new = [(f"k{i}", "x", float(i), i) for i in
               rng.sample(range(60), 15) if f"k{i}" not in want]
        new += [(k, "late", 0.0, 999) for k, *_ in new[:3]]     # of one key the first counts
        store.insert(rows(spark, *new) if new else rows(spark, ("k0", "z", 0.0, 0)).limit(0))
        for k, a, n, o in new:
            want.setdefault(k, (a, n, o))
        some = rng.sample(sorted(want), 5)
        moves = [(k, f, v, o) for k in some for f, v, o in (
            ("a", f"s{step}", 2), ("a", "earlier", 1), ("n", str(step + .5), 1),
            ("a", None, 0), ("nope", "x", 1))]
        store.write(patches=patches(spark, *moves))
        for k in some:
            want[k] = (f"s{step}", step + .5, want[k][2])
        if step in (2, 4):
            before = store.manifest()
            store.compact()
            assert store.manifest()["deltas"] == [] and before["deltas"]
        assert rows_of(store.read()) == want
    assert set(r["id"] for r in store.keys().collect()) == set(want)
    one = sorted(want)[0]
    assert rows_of(store.lookup(one)) == {one: want[one]}


def test_a_batch_writes_only_its_rows(spark, folder):
    store = table(spark, folder)
    store.insert(spark.range(500).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("x").alias(
        "a"), F.lit(1.0).alias("n"), F.col("id").alias("ord")))
    store.compact()
    base = store.manifest()["base"]
    store.write(patches=patches(spark, ("k7", "a", "y", 1)))
    delta = store.manifest()["deltas"][0]
    written = spark.read.parquet(f"{store.root}/{delta}/patches")
    assert written.count() == 1 and store.manifest()["base"] == base
    # Compaction rewrites the touched bucket only.
    store.compact()
    after = store.manifest()["base"]
    assert sum(after[b] != base[b] for b in base) == 1
    assert rows_of(store.read())["k7"][0] == "y" and store.read().count() == 500
    gone = store.vacuum()
    assert delta in gone and store.read().count() == 500
    assert len(store.versions()) == 1


def test_repeated_batches_and_two_writers(spark, folder):
    store = table(spark, folder)
    store.insert(rows(spark, ("a", "x", 1.0, 1)), batch=0, stream="s")
    version = store.insert(rows(spark, ("b", "x", 1.0, 1)), batch=0, stream="s")
    assert version == 1 and rows_of(store.read()) == {"a": ("x", 1.0, 1)}
    store.insert(rows(spark, ("b", "x", 1.0, 1)), batch=0, stream="other")
    assert set(rows_of(store.read())) == {"a", "b"}
    manifest = store.manifest()
    with pytest.raises(VersionTaken):
        store._commit(manifest)
    # What a failed writer left is no part of any version.
    os.makedirs(f"{store.root}/delta-{manifest['version'] + 1:010d}/puts/bucket=0")
    assert set(rows_of(store.read())) == {"a", "b"}
    assert rows_of(store.read(version=1)) == {"a": ("x", 1.0, 1)}


def test_empty_store_and_nulls(spark, folder):
    store = table(spark, folder)
    assert store.read().count() == 0 and store.keys().count() == 0 and store.compact() == 0
    store.insert(rows(spark, (None, "x", 1.0, 1), ("a", None, None, 2)))
    assert rows_of(store.read()) == {"a": (None, None, 2)}
    store.write(patches=patches(spark, ("ghost", "a", "y", 1), ("a", "a", "y", 1)))
    assert rows_of(store.read()) == {"a": ("y", None, 2)}
    store.compact()
    assert rows_of(store.read()) == {"a": ("y", None, 2)}
