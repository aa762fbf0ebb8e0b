"""Registered queries of the operators, with oracle statements where SQL can say them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from licmatch.llm import (bpe, centroids, host_paths, line_dedup, minhash, mixture, ngram_join,
                          periodic_runs, pii, recompression, repetition, secret_ledger, toxicity)
from licmatch.llm.frames import read_documents, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read_documents(spark, sf_dir))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_table(read_documents(spark, sf_dir))


@query("op9_recompression")
def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.substring_dedup(read_documents(spark, sf_dir)).drop("kept")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_documents(spark, sf_dir), ["doc_id"], with_ids=False)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_documents(spark, sf_dir),
                             spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(read_documents(spark, sf_dir))


@query("op6_source_mix", mixture.ORACLE)
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(read_documents(spark, sf_dir)).drop("copies")


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_documents(spark, sf_dir))


@query("op4_personal_data")
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_documents(spark, sf_dir))


@query("op5_secret_ledger")
def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.secrets(read_documents(spark, sf_dir))


@query("op11_centroids", centroids.ORACLE)
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(read_documents(spark, sf_dir), planted=True)


@query("op13_host_paths")
def op13_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
