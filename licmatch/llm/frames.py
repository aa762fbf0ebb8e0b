"""Frame helpers shared by the operators: intake, staged tables, connected components."""
from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows without a doc_id count as one last document.
NO_ID = 2**63 - 1
#: Spark's setting under which a query's shuffle files go when the query has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, so that tasks can import it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="licmatch-")) / "licmatch_llm.zip"
        with zipfile.ZipFile(target, "w") as archive:
            archive.write(root.parent / "__init__.py", "licmatch/__init__.py")
            for file in sorted(root.glob("*.py")):
                archive.write(file, f"licmatch/llm/{file.name}")
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text), a missing text being empty and a missing id ``NO_ID``."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def public_id(name: str = "doc_id"):
    """The id as callers know it: ``NO_ID`` is null again."""
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def shared_folder(spark: SparkSession) -> str:
    """A new folder where the cluster keeps checkpoints, in the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there.

    Losing an executor afterwards costs a re-read, never the work before. Spark deletes the
    shuffle files of the write as soon as it has ended, so that only one step's are on disk.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(folder)


def drop_staged(df: DataFrame) -> None:
    """Delete the folder of a staged table that nothing will read any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as links (a, b): the least node reachable.

    Minimum labels spread along the links and are shortcut through the label's own label, so
    the number of rounds follows the logarithm of the longest path. Nodes without a link do
    not appear.
    """
    edges = stage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    label = stage(edges.groupBy(F.col("a").alias("node"))
                  .agg(F.min(F.least("a", "b")).alias("component")))
    total = F.sum(F.col("component").cast("decimal(38,0)"))
    before = label.agg(total).first()[0]
    while before is not None:
        near = (edges.join(label, F.col("b") == F.col("node"))
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        step = label.join(near, "node").select("node", F.least("component", "near").alias("via"))
        label = stage(step.join(label.withColumnRenamed("node", "via"), "via")
                      .select("node", F.least("component", "via").alias("component")))
        after = label.agg(total).first()[0]
        if after == before:
            break
        before = after
    return label
