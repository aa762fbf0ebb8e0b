"""Staged tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from licmatch.llm import frames


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    return {name for k in range(files.size())
            if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_stage_leaves_no_shuffle_files(spark):
    setting = spark.conf.get(frames.CLEAN_SHUFFLES)
    before = shuffle_files(spark)
    rows = spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count()
    staged = frames.stage(rows)
    assert not shuffle_files(spark) - before
    assert sorted(tuple(r) for r in staged.collect()) == [(k, 143 if k < 6 else 142)
                                                          for k in range(7)]
    assert spark.conf.get(frames.CLEAN_SHUFFLES) == setting
