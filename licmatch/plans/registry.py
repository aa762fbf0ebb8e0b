"""Registry of queries: a Spark plan and, where SQL can say it, its oracle statement."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from licmatch.plans.fixtures import Tables
from licmatch.plans.oracle import statement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@contextmanager
def split_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """File splits of so many bytes, to have several of them in small files too."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, str(size))
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def _plain(df: DataFrame) -> DataFrame:
    """Result columns in types both engines share: whole numbers are bigint."""
    return df.select(*[
        F.col(f"`{name}`").cast("bigint").alias(name)
        if kind in ("int", "smallint", "tinyint") else F.col(f"`{name}`")
        for name, kind in df.dtypes])


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _plain(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = statement(sql)
        return fn
    return register
