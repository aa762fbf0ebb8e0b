"""A keyed table as base plus deltas, merged when it is read.

Rows are bucketed by a hash of their key. A batch of new rows or of field-level changes writes
nothing but itself, as a delta folder; a read lays the deltas over the base with one join on
the key. ``compact`` rewrites the buckets that deltas touch, and no others.

A manifest says which folders make up a version. It is a small file that is created once, so of
two writers one fails and has to read again; readers always see a complete version. A batch
number that a manifest already holds is not applied twice, so a repeated micro-batch changes
nothing.
"""
from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from licmatch.schema import struct
from licmatch.sources.staging import delete, file_system

BUCKETS = 64
PATCH = struct(("_key", T.StringType()), ("field", T.StringType()), ("value", T.StringType()),
               ("ord", T.LongType()))


class VersionTaken(RuntimeError):
    """Another writer made this version first."""


class DeltaStore:
    """Table of ``columns`` keyed by ``key`` below a folder ``root``."""

    def __init__(self, spark: SparkSession, root: str, columns: T.StructType, key: str = "id",
                 buckets: int = BUCKETS):
        self.spark, self.root, self.columns, self.key = spark, root.rstrip("/"), columns, key
        self.buckets = buckets

    # --- manifest -----------------------------------------------------------------------------

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifest/{version:010d}.json"

    def versions(self) -> list[int]:
        system, at = file_system(self.spark, f"{self.root}/manifest")
        if not system.exists(at):
            return []
        names = [s.getPath().getName() for s in system.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """``base`` (bucket to folder), ``deltas`` (folders, oldest first), ``batches``."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": self.buckets, "base": {}, "deltas": [],
                    "batches": {}}
        path = self._manifest_path(known[-1] if version is None else version)
        system, at = file_system(self.spark, path)
        stream = system.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(
                stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> int:
        path = self._manifest_path(manifest["version"])
        system, at = file_system(self.spark, path)
        if system.exists(at):
            raise VersionTaken(path)
        stream = system.create(at, False)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            stream.close()
        return manifest["version"]

    # --- writing ------------------------------------------------------------------------------

    def _bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")

    def _save(self, rows: DataFrame, key: str, folder: str, buckets: int) -> None:
        """One folder per bucket; a crowded bucket is written by several tasks."""
        rows.select("*", self._bucket(F.col(key), buckets)) \
            .hint("rebalance", "bucket") \
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")

    def _folders(self, folder: str) -> list[int]:
        """Buckets that a folder holds."""
        system, at = file_system(self.spark, f"{self.root}/{folder}")
        if not system.exists(at):
            return []
        names = [s.getPath().getName() for s in system.listStatus(at)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))

    def write(self, puts: DataFrame | None = None, patches: DataFrame | None = None,
              batch: int | None = None, stream: str = "") -> int:
        """Add new rows (of new keys) and patches (key, field, value[, ord]) as one delta.

        Of several patches of one field of a key the last by ``ord`` counts, and those of a
        later delta come after all of an earlier one. Returns the version that holds it; a batch
        that the store has already is left alone.
        """
        before = self.manifest()
        if batch is not None and batch <= before["batches"].get(stream, -1):
            return before["version"]
        after = dict(before, version=before["version"] + 1)
        folder = f"delta-{after['version']:010d}"
        if puts is not None:
            self._save(self._conform(puts), self.key, f"{folder}/puts", after["buckets"])
        if patches is not None:
            order = F.col("ord") if "ord" in patches.columns else F.lit(0)
            slim = patches.select(F.col(self.key).cast("string").alias("_key"), "field",
                                  F.col("value").cast("string").alias("value"),
                                  order.cast("bigint").alias("ord"))
            self._save(slim.filter(F.col("field").isin(*self._fields())), "_key",
                       f"{folder}/patches", after["buckets"])
        after["deltas"] = [*before["deltas"], folder]
        if batch is not None:
            after["batches"] = {**before["batches"], stream: batch}
        return self._commit(after)

    def insert(self, rows: DataFrame, order: str = "ord", batch: int | None = None,
               stream: str = "") -> int:
        """Add the rows whose key is not there yet; of one key the first by ``order``."""
        from licmatch.operators.frames import first_per_key
        if batch is not None and batch <= self.manifest()["batches"].get(stream, -1):
            return self.manifest()["version"]
        fresh = first_per_key(rows.filter(F.col(self.key).isNotNull()), [self.key], [order])
        return self.write(fresh.join(self.keys(), self.key, "left_anti"), batch=batch,
                          stream=stream)

    def compact(self) -> int:
        """Lay the deltas into the buckets they touch; other buckets keep their folder."""
        before = self.manifest()
        if not before["deltas"]:
            return before["version"]
        touched = sorted({b for d in before["deltas"] for kind in ("puts", "patches")
                          for b in self._folders(f"{d}/{kind}")})
        after = dict(before, version=before["version"] + 1, deltas=[])
        folder = f"base-{after['version']:010d}"
        if touched:
            self._save(self.read(buckets=touched), self.key, folder, before["buckets"])
            base = {b: f for b, f in before["base"].items() if int(b) not in touched}
            base.update({str(b): folder for b in self._folders(folder)})
            after["base"] = base
        return self._commit(after)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete folders that none of the last ``keep`` versions uses; older versions go."""
        known = self.versions()
        used = set()
        for version in known[-keep:]:
            manifest = self.manifest(version)
            used |= {*manifest["deltas"], *manifest["base"].values()}
        system, at = file_system(self.spark, self.root)
        names = [s.getPath().getName() for s in system.listStatus(at)]
        gone = [n for n in names if n.startswith(("base-", "delta-")) and n not in used]
        for version in known[:-keep]:  # a version goes before its folders do
            delete(self.spark, self._manifest_path(version))
        for name in gone:
            delete(self.spark, f"{self.root}/{name}")
        return sorted(gone)

    # --- reading ------------------------------------------------------------------------------

    def _fields(self) -> list[str]:
        return [f.name for f in self.columns if f.name != self.key]

    def _conform(self, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None))
                             .cast(f.dataType).alias(f.name) for f in self.columns])

    def _load(self, paths: Iterable[str], columns: T.StructType) -> DataFrame:
        paths = list(paths)
        if not paths:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*paths)

    def _paths(self, manifest: dict, kind: str, wanted: set[int] | None) -> list[list[str]]:
        """Per delta the folders of its buckets."""
        return [[f"{self.root}/{d}/{kind}/bucket={b}" for b in self._folders(f"{d}/{kind}")
                 if wanted is None or b in wanted] for d in manifest["deltas"]]

    def _rows(self, manifest: dict, wanted: set[int] | None) -> DataFrame:
        base = [f"{self.root}/{f}/bucket={b}" for b, f in sorted(manifest["base"].items())
                if wanted is None or int(b) in wanted]
        puts = [p for paths in self._paths(manifest, "puts", wanted) for p in paths]
        return self._load([*base, *puts], self.columns)

    def keys(self) -> DataFrame:
        """The keys there are: only the key column is read."""
        return self._rows(self.manifest(), None).select(self.key)

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None
             ) -> DataFrame:
        """All rows of a version, deltas laid over the base."""
        manifest = self.manifest(version)
        wanted = None if buckets is None else set(buckets)
        rows = self._rows(manifest, wanted)
        layers = [self._load(paths, PATCH).withColumn("_layer", F.lit(i))
                  for i, paths in enumerate(self._paths(manifest, "patches", wanted)) if paths]
        if not layers:
            return rows
        patches = layers[0]
        for layer in layers[1:]:
            patches = patches.unionByName(layer)
        last = patches.groupBy("_key", "field").agg(
            F.max_by("value", F.struct("_layer", "ord")).alias("value"))
        wide = last.groupBy("_key").agg(F.map_from_entries(
            F.collect_list(F.struct("field", "value"))).alias("_new"))
        joined = rows.join(wide, F.col(self.key).cast("string") == F.col("_key"), "left")

        def patched(f: T.StructField) -> Column:
            if f.name == self.key:
                return F.col(f.name)
            return F.when(F.map_contains_key("_new", f.name),
                          F.element_at("_new", F.lit(f.name)).cast(f.dataType)) \
                .otherwise(F.col(f.name)).alias(f.name)
        return joined.select(*[patched(f) for f in self.columns])

    def lookup(self, key: str) -> DataFrame:
        """The row of one key: only its bucket is read."""
        manifest = self.manifest()
        at = self.spark.range(1).select(
            self._bucket(F.lit(key), manifest["buckets"])).first()["bucket"]
        return self.read(buckets=[at]).filter(F.col(self.key) == key)
