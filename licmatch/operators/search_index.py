"""Contains search through an inverted index of trigrams.

Entries (a text and columns that go with it) are numbered and cut into blocks. The index has
one row per trigram and block: the sorted numbers of the block's entries that hold it, so a
trigram that every entry has is many rows of bounded size. A search reads the rows of the
query's trigrams (filters reach the Parquet scan, whose rows are sorted by trigram), intersects
the arrays block by block, and reads the entries of the blocks that are left to verify them.
The scan of all texts is done once, when the index is built.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from licmatch.functions.text import normalize_name
from licmatch.operators.frames import number_by_range
from licmatch.sources.staging import shared_folder

GRAM = 3
#: Entries of a block: the most numbers one row of the index holds.
BLOCK = 65536
#: Stands before a text and twice behind it, so starts and short queries have trigrams too.
EDGE = "\u0001"
GRAMS = "gram string, _block bigint, numbers array<bigint>"


def _edged(text: str) -> Column:
    return F.concat(F.lit(EDGE), F.col(text), F.lit(EDGE * (GRAM - 1)))


@dataclass(frozen=True)
class SearchIndex:
    """Folders of a built index; ``text`` names the searched column."""
    spark: SparkSession
    folder: str
    text: str
    schema: T.StructType

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def entries(self) -> DataFrame:
        numbered = T.StructType([*self.schema, T.StructField("_n", T.LongType()),
                                 T.StructField("_block", T.LongType())])
        return self.spark.read.schema(numbered).parquet(f"{self.folder}/entries")

    def grams(self) -> DataFrame:
        return self.spark.read.schema(GRAMS).parquet(f"{self.folder}/grams")


def build(rows: DataFrame, text: str, order: list[str], folder: str | None = None,
          block: int = BLOCK) -> SearchIndex:
    """Index ``rows`` by a text column; ``order`` gives the numbers of the entries."""
    spark = rows.sparkSession
    folder = folder or shared_folder(spark)
    numbered = number_by_range(rows.filter(F.col(text).isNotNull()), order, "_n", start=0,
                               folder=f"{folder}/numbers") \
        .withColumn("_block", F.expr(f"_n div {block}"))
    # The numbered rows lie in files by ranges of their number, so a block is in few of them.
    numbered.sortWithinPartitions("_block", "_n").write.partitionBy("_block") \
        .parquet(f"{folder}/entries")
    # Texts are brought together by block, not their trigrams: those are made and folded there.
    edged = numbered.select("_block", "_n", _edged(text).alias("_text")).repartition("_block")
    grams = edged.select("_block", "_n", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.char_length("_text") - (GRAM - 1)),
        lambda i: F.substring(F.col("_text"), i, F.lit(GRAM))))).alias("gram"))
    postings = grams.groupBy("gram", "_block").agg(
        F.array_sort(F.collect_list("_n")).alias("numbers"))
    postings.sortWithinPartitions("gram", "_block").write.parquet(f"{folder}/grams")
    return SearchIndex(spark, folder, text, rows.schema)


def query_grams(query: str) -> list[str]:
    return sorted({query[i:i + GRAM] for i in range(len(query) - GRAM + 1)})


def candidates(index: SearchIndex, query: str) -> DataFrame:
    """(_block, _n) of the entries that hold all trigrams of the query.

    A query shorter than a trigram meets the trigrams that begin with it.
    """
    if len(query) < GRAM:
        found = index.grams().filter(F.col("gram").startswith(query))
        return found.select("_block", F.explode("numbers").alias("_n")).distinct()
    wanted = query_grams(query)
    found = index.grams().filter(F.col("gram").isin(*wanted))
    # At most one array per trigram of the query in a group, each of a block's size at most.
    met = found.groupBy("_block").agg(F.collect_list("numbers").alias("_lists")) \
        .filter(F.size("_lists") == len(wanted))
    return met.select("_block", F.explode(F.aggregate(
        F.slice("_lists", F.lit(2), F.size("_lists")), F.element_at("_lists", 1),
        lambda done, more: F.array_intersect(done, more))).alias("_n"))


def containing(index: SearchIndex, query: str) -> DataFrame:
    """The rows whose text contains the query (letters as they are)."""
    met = candidates(index, query)
    return index.entries().join(met, ["_block", "_n"], "left_semi") \
        .filter(F.contains(F.col(index.text), F.lit(query))).select(*index.columns)


def starting(index: SearchIndex, query: str) -> DataFrame:
    """The rows whose text starts with the query."""
    return index.entries().join(candidates(index, EDGE + query), ["_block", "_n"], "left_semi") \
        .filter(F.col(index.text).startswith(query)).select(*index.columns)


def register_index(lookup: DataFrame, folder: str | None = None) -> SearchIndex:
    return build(lookup.select("key", "rating"), "key", ["key"], folder)


def register_search(index: SearchIndex, query: str, limit: int = 20) -> DataFrame:
    """Register entries for a typed name: prefix hits of the same first word if there are
    enough, else any hit. Queries of fewer than two letters find nothing."""
    q = index.spark.range(1).select(normalize_name(F.lit(query)).alias("q")).first()["q"]
    if len(q) < 2:
        found = index.entries().select("key", "rating").limit(0)
    else:
        same_word = F.substring_index("key", " ", 1) == q.split(" ")[0]
        first = starting(index, q).filter(same_word)
        enough = first.limit(limit).count() >= limit
        found = first if enough else containing(index, q)
    return found.select(F.col("key").alias("register_name"), "rating") \
        .orderBy("register_name", "rating").limit(limit)


def prefix_or_contains(index: SearchIndex, prefix: str, part: str) -> DataFrame:
    """Entries that start with one text or contain another, each once."""
    return starting(index, prefix).union(containing(index, part)).distinct()
