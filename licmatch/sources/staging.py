"""Tables between the steps of a job, in the folder that the cluster shares.

A staged table cuts the lineage: an executor lost later costs a re-read, never the work before.
Nothing is written to a machine's own temporary folder.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def own_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, or in the warehouse where that
    is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None) \
        or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/licmatch-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the application's own."""
    return f"{own_folder(spark)}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged; nothing it returned can be read after."""
    delete(spark, own_folder(spark))


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The frame written once and read back."""
    folder = folder or shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, whichever store the path is in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, folder: str) -> None:
    system, at = file_system(spark, folder)
    system.delete(at, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """A shared folder that is deleted at the end of the block, tables in it included."""
    folder = shared_folder(spark)
    try:
        yield folder
    finally:
        delete(spark, folder)
