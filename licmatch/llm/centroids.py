"""Centroid clustering over an exact, incrementally kept distance matrix.

Every vector keeps its integer dot product with each centroid. When centroids move, only the
components that changed are multiplied: ``dot += delta * component`` per nonzero component
change of a centroid, then the smallest distance is looked for again. All of it is integer
arithmetic, so the result doesn't depend on partitioning or the order of addition.

The state (vector, dot products, cluster) is a staged table per round, deleted when the next
one is written; a lost executor costs a re-read. The driver holds the centroids alone.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from licmatch.llm.frames import drop_staged, stage

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
#: With components below this, every sum of products fits in 64 bits; beyond it the same steps
#: run on Python's whole numbers and decimals.
NARROW = 2**26
#: Components from here on could overflow decimal(38): such vectors are not kept.
WIDEST = 2**59

STATE = "vec_id long, vector array<{0}>, dots array<{0}>, cluster int, distance long"


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the vectors with 64 finite components, as whole numbers."""
    def small(x: Column) -> Column:
        # NaN and infinity are greater than any bound, a null makes the whole null
        return F.coalesce(F.abs(x.cast("double")) < float(WIDEST // 64), F.lit(False))

    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long"))
    return (vectors.where((F.size("embedding") == DIMENSIONS) & F.forall("embedding", small))
            .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = 1) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed:vec_id``, at most ``clusters`` of them.

    Rows of one id are told apart by their components; rows without id start no centroid.
    """
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = (kept.where(F.col("vec_id").isNotNull()).withColumn("rank", rank)
            .orderBy("rank", "vector").limit(clusters).collect())
    return [list(row.vector) for row in rows]


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    flat = column.flatten()
    if kind is object:
        return np.array([int(x) for x in flat.to_pylist()], dtype=object).reshape(-1, width)
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(matrix: np.ndarray, kind: type) -> pa.Array:
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    flat = (pa.array([int(x) for x in matrix.ravel()], pa.decimal128(38, 0)) if kind is object
            else pa.array(matrix.ravel()))
    return pa.ListArray.from_arrays(offsets, flat)


def _assign(centroids: np.ndarray, deltas: np.ndarray | None, kind: type):
    """Task function: brings the dot products up to date and assigns every vector."""
    squares = (centroids * centroids).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"), centroids.shape[1], kind)
            if deltas is None:
                dots = vectors @ centroids.T
            else:
                dots = _matrix(batch.column("dots"), len(centroids), kind).copy()
                for k, delta in enumerate(deltas):
                    moved = np.flatnonzero(delta)
                    if len(moved):
                        dots[:, k] += vectors[:, moved] @ delta[moved]
            distance = (vectors * vectors).sum(axis=1)[:, None] - 2 * dots + squares[None, :]
            cluster = np.argmin(distance, axis=1)  # the first of equal ones
            least = distance[np.arange(len(cluster)), cluster]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), _lists(dots, kind),
                 pa.array(cluster, pa.int32()),
                 pa.array([int(x) if x < 2**63 else None for x in least.tolist()], pa.int64())],
                ["vec_id", "vector", "dots", "cluster", "distance"])
    return run


def _sums(width: int, kind: type):
    """Task function: per batch and cluster the number of vectors and their sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"), width, kind)
            cluster = batch.column("cluster").to_numpy()
            present = np.unique(cluster)
            sums = np.stack([vectors[cluster == k].sum(axis=0) for k in present])
            yield pa.RecordBatch.from_arrays(
                [pa.array(present.astype(np.int32)),
                 pa.array([int((cluster == k).sum()) for k in present], pa.int64()),
                 _lists(sums.astype(object), object)], ["cluster", "members", "sums"])
    return run


def moved_centroids(state: DataFrame, centroids: np.ndarray, kind: type) -> np.ndarray:
    """Per cluster floor(sum / count) by component; a cluster without vectors stays."""
    width = centroids.shape[1]
    partial = (state.select("vector", "cluster")
               .mapInArrow(_sums(width, kind), "cluster int, members long, "
                                               "sums array<decimal(38,0)>")
               .select("cluster", "members", F.posexplode("sums").alias("at", "part")))
    rows = (partial.groupBy("cluster", "at")
            .agg(F.sum("members").alias("members"), F.sum("part").alias("total")).collect())
    moved = centroids.copy()
    for row in rows:  # clusters x components of them
        moved[row.cluster, row.at] = int(row.total) // row.members
    return moved


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector its cluster and squared distance, sums of distances, centroid digest.

    Not kept: null vectors, vectors of another length, with a null, non-finite or immense
    (over 2^53) component. Rows of one id, or without id, are clustered each by themselves;
    rows without id start no centroid, and where no row has an id the result is empty. With
    fewer vectors than ``clusters`` there are that many centroids. A distance that
    exceeds 64 bits is null, and so are the sums over it.
    """
    kept = kept_vectors(vectors)
    start = first_centroids(kept, clusters)
    if not start:
        return (kept.limit(0).select("vec_id", F.lit(0).alias("cluster"),
                                     *[F.lit(0).cast("long").alias(c) for c in
                                       ("distance", "cluster_inertia", "inertia")],
                                     F.lit("").alias("centroid_sha256")))
    widest = kept.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    kind = np.int64 if widest < NARROW else object
    schema = STATE.format("long" if kind is np.int64 else "decimal(38,0)")
    if kind is object:
        kept = kept.withColumn("vector", F.col("vector").cast("array<decimal(38,0)>"))
    centroids = np.array(start, dtype=kind)
    state = stage(kept.mapInArrow(_assign(centroids, None, kind), schema))
    for _ in range(rounds):
        moved = moved_centroids(state, centroids, kind)
        deltas, centroids = moved - centroids, moved
        before = state
        state = stage(before.mapInArrow(_assign(centroids, deltas, kind), schema))
        drop_staged(before)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = F.count("distance") == F.count(F.lit(1))
    inertias = {row.cluster: None if row.total is None else int(row.total)
                for row in state.groupBy("cluster")
                .agg(F.when(whole, total).alias("total")).collect()}

    def fitting(x: int | None) -> Column:
        return F.lit(x if x is not None and x < 2**63 else None).cast("long")

    everything = None if None in inertias.values() else sum(inertias.values())
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()
               for c in centroids]
    at = F.col("cluster") + 1
    return state.select(
        "vec_id", "cluster", "distance",
        F.element_at(F.array(*[fitting(inertias.get(k, 0)) for k in range(len(centroids))]), at)
        .alias("cluster_inertia"),
        fitting(everything).alias("inertia"),
        F.element_at(F.array(*[F.lit(d) for d in digests]), at).alias("centroid_sha256"))


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same clustering from scratch in each round, in DuckDB."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS}
    AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = {DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v
  FROM kept WHERE vec_id IS NOT NULL
  QUALIFY k < {clusters})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT row, k, list_sum(list_transform(list_zip(a.v, c.v),
             lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM kept a, c{r} c) GROUP BY row)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT k, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT k, list(CAST(floor_mean AS BIGINT) ORDER BY i) AS v FROM (
      SELECT k, i, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS floor_mean
      FROM (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
              SELECT k, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i
              FROM kept JOIN a{r} USING (row)) GROUP BY k, i)) GROUP BY k) n USING (k))""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a USING (row) JOIN c{rounds} c ON a.k = c.k"""


ORACLE = _oracle()
