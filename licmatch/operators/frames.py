"""Small relational idioms shared by the operators, all safe against hot keys."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from licmatch.sources.staging import shared_folder, staged


def first_per_key(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key.

    ``row_number() <= n`` becomes a window group limit that also runs before the shuffle,
    so a hot key sends at most n rows per task, however many rows it has.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n)
    return ranked.drop("_rn")


def carry_forward(df: DataFrame, group: list[str], order: str, value: str, out: str,
                  chunk: int = 4096) -> DataFrame:
    """Last non-null ``value`` at or before each row, by an integer ``order``.

    A group of any length is cut into chunks of the order column: one window inside each
    chunk, one over the chunk ends. No task holds more than a chunk, or one row per chunk.
    """
    cut = df.withColumn("_chunk", F.expr(f"cast(`{order}` as bigint) div {chunk}"))
    keys = [*group, "_chunk"]
    inside = Window.partitionBy(*keys).orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    ends = cut.filter(F.col(value).isNotNull()).groupBy(*keys) \
        .agg(F.max_by(value, order).alias("_end"))
    before = Window.partitionBy(*group).orderBy("_chunk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.select(*keys).distinct().join(ends, keys, "left") \
        .withColumn("_carry", F.last("_end", ignorenulls=True).over(before)) \
        .select(*keys, "_carry")
    return local.join(carried, keys, "left") \
        .withColumn(out, F.coalesce("_local", "_carry")) \
        .drop("_chunk", "_local", "_carry")


def _sizes_before(sizes: DataFrame, fan: int = 65536, levels: int = 3) -> DataFrame:
    """(_chunk, _offset): the sum of ``_size`` over all smaller chunk numbers.

    A tree of running sums: inside groups of ``fan`` consecutive numbers, and over the groups
    the same again. The last level has at most a few ten thousand rows, whatever the numbers.
    """
    if not levels:
        before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.select("_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0))
                            .alias("_offset"))
    grouped = sizes.withColumn("_group", F.expr(f"_chunk div {fan}"))
    upper = _sizes_before(grouped.groupBy(F.col("_group").alias("_chunk"))
                          .agg(F.sum("_size").alias("_size")), fan, levels - 1)
    before = Window.partitionBy("_group").orderBy("_chunk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    inside = grouped.withColumn("_inside", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return inside.join(upper.withColumnRenamed("_chunk", "_group"), "_group") \
        .select("_chunk", (F.col("_inside") + F.col("_offset")).alias("_offset"))


def dense_sequence(df: DataFrame, order: str, out: str, start: Column | int = 1,
                   chunk: int = 65536) -> DataFrame:
    """Consecutive numbers in the order of a unique integer column, without one task holding
    everything: numbers inside chunks of the order column plus chunk offsets."""
    cut = df.withColumn("_chunk", F.expr(f"cast(`{order}` as bigint) div {chunk}"))
    rows = cut.withColumn("_n", F.row_number().over(
        Window.partitionBy("_chunk").orderBy(order)))
    offsets = _sizes_before(cut.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_size")))
    base = start if isinstance(start, Column) else F.lit(start)
    return rows.join(offsets, "_chunk") \
        .withColumn(out, (F.col("_n") + F.col("_offset") + base - 1).cast("bigint")) \
        .drop("_chunk", "_n", "_offset")


def number_by_range(df: DataFrame, order: list, out: str, start: int = 1,
                    partitions: int | None = None, folder: str | None = None) -> DataFrame:
    """Consecutive numbers in a global order, without a window over more than a partition count.

    Rows are dealt out by range and sorted inside their partitions, and that is written down once
    (``staging.staged``), so each row has a partition and a place in it that no re-run can
    change. A row's number is its place plus the sizes of the partitions before: one row per
    partition is added up, whatever the size of the input. Rows equal in ``order`` are told
    apart by all their columns, so a value that a third of the rows share is dealt out too;
    identical rows get their numbers in any order. The two tables stay in ``folder`` (shared,
    by default) for as long as the result is read.
    """
    folder = folder or shared_folder(df.sparkSession)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = F.xxhash64(*[F.col(c) for c, kind in df.dtypes if not kind.startswith("map")])
    ranged = df.withColumn("_spread", spread)
    ranged = ranged.repartitionByRange(*([partitions] if partitions else []), *keys, "_spread")
    placed = staged(ranged.sortWithinPartitions(*keys, "_spread").drop("_spread")
                    .withColumn("_at", F.monotonically_increasing_id()), f"{folder}/rows")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(2 ** 33 - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0))
                                  .alias("_offset")), f"{folder}/offsets")
    return placed.withColumn("_part", part).join(offsets, "_part") \
        .withColumn(out, (F.col("_offset") + place + start).cast("bigint")) \
        .select(*df.columns, out)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).cast("bigint")
