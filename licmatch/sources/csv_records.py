"""CSV files with line breaks inside quotes, read in parallel.

A line begins a record exactly if an even number of quotes stands before it in its file. Every
split counts its quotes for itself; a running sum over the splits, one row each, tells the
parity and the record number that a split begins with. Lines that are records by themselves stay
where they are; only the lines of broken-up records are brought together, record by record.
A record may reach over any number of splits.

The number of a record in the scan is its ``ord``, so the order of a file never depends on how
it was cut.
"""
from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

_LINES = ("file string, split bigint, line bigint, value string, odd boolean, inside boolean, "
          "starts bigint")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per line of a split: its place, whether its quotes are odd, whether it lies inside quotes
    and how many lines up to it don't, as if the split began outside of quotes.

    The lines of a split come in order in one task.
    """
    at, lines, parity, begun = None, 0, 0, 0
    for batch in batches:
        split = list(zip(batch.column("file").to_pylist(), batch.column("split").to_pylist()))
        odd = np.asarray(pc.count_substring(batch.column("value"), '"')) % 2
        place, inside, starts = (np.zeros(len(odd), dtype=np.int64) for _ in range(3))
        cuts = [0, *[i for i in range(1, len(split)) if split[i] != split[i - 1]], len(split)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if split[lo] != at:
                at, lines, parity, begun = split[lo], 0, 0, 0
            before = (parity + np.concatenate(([0], np.cumsum(odd[lo:hi])))) % 2
            inside[lo:hi] = before[:-1]
            starts[lo:hi] = begun + np.cumsum(1 - before[:-1])
            place[lo:hi] = lines + np.arange(hi - lo)
            lines, parity, begun = lines + hi - lo, int(before[-1]), int(starts[hi - 1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("split"), pa.array(place),
             batch.column("value"), pa.array(odd == 1), pa.array(inside == 1), pa.array(starts)],
            ["file", "split", "line", "value", "odd", "inside", "starts"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, record): the records of all files, numbered from 1 in each."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"), "value")
    lines = raw.mapInArrow(_counted, _LINES)
    splits = lines.groupBy("file", "split").agg(
        (F.count_if("odd") % 2).alias("odd"), F.count(F.lit(1)).alias("lines"),
        F.max("starts").alias("starts"))
    before = Window.partitionBy("file").orderBy("split") \
        .rowsBetween(Window.unboundedPreceding, -1)
    entered = splits.withColumn("enters", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2) \
        .withColumn("own", F.when(F.col("enters") == 0, F.col("starts"))
                    .otherwise(F.col("lines") - F.col("starts"))) \
        .select("file", "split", "enters",
                F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"))
    flipped = F.col("enters") == 1
    placed = lines.join(entered, ["file", "split"]).select(
        "file", "split", "line", "value", "odd",
        (F.col("inside") != flipped).alias("inside"),
        (F.col("first") + F.when(flipped, F.col("line") + 1 - F.col("starts"))
         .otherwise(F.col("starts"))).alias("number"))
    alone = ~F.col("inside") & ~F.col("odd")
    whole = placed.filter(alone).select("file", "number", F.col("value").alias("record"))
    parts = placed.filter(~alone).groupBy("file", "number").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("split", "line", "value"))),
        lambda p: p["value"]), "\n").alias("record"))
    return whole.unionByName(parts).select("file", "number",
                                           F.regexp_replace("record", "\r$", "").alias("record"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with columns taken by name, all text, and ``ord``, the number of the row in the
    scan (files by name). A byte-order mark and empty records are dropped.

    Quotes inside a field are doubled; a field without quotes around it holds none. All files
    have the header of the first.
    """
    found = records(spark, path)
    first = found.filter("number = 1").agg(F.min_by("record", "file")).first()[0]
    if first is None:
        return spark.createDataFrame([], "ord bigint")
    names = next(csv.reader([first.lstrip("﻿")]))
    columns = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    kept = found.filter((F.col("number") > 1) & (F.trim("record") != ""))
    sizes = kept.groupBy("file").agg((F.max("number") - 1).alias("size"))  # without the header
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    offsets = sizes.select("file", F.coalesce(F.sum("size").over(before), F.lit(0))
                           .alias("offset"))
    ddl = ", ".join(f"{f.name} string" for f in columns)
    row = F.from_csv("record", ddl, {"escape": '"', "multiLine": "true"})
    return kept.join(offsets, "file").select(
        row.alias("row"), (F.col("offset") + F.col("number") - 2).alias("ord")).select(
        *[F.col("row")[f.name].alias(name) for f, name in zip(columns, names)], "ord")
