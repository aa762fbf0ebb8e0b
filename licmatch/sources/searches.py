"""Saved searches and the synthetic data set."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from licmatch import rules, schema


def search_plan(spark: SparkSession) -> DataFrame:
    """Tiers x keywords (x categories) as saved-search rows."""
    tiers = [(tier, words, [c or "" for c in cats])
             for tier, words, cats in rules.SEARCH_TIERS]
    base = spark.createDataFrame(tiers, "tier string, words array<string>, "
                                        "categories array<string>")
    shared = rules.SEARCH_SHARED
    spread = base.select("tier", F.explode("words").alias("keywords"), "categories") \
        .select("tier", "keywords", F.explode("categories").alias("category"))
    return spread.select(
        "keywords", F.lit(shared["location"]).alias("location"),
        F.lit(shared["distance"]).cast("int").alias("distance"),
        F.lit(shared["contract_type"]).alias("contract_type"),
        F.lit(shared["salary_include_unknown"]).alias("salary_include_unknown"),
        F.nullif("category", F.lit("")).alias("category"),
        F.lit(shared["max_days_old"]).alias("max_days_old"), "tier") \
        .select(*schema.SAVED_SEARCH.fieldNames())


def search_hits(plan: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings per saved search: every word run of a title is a key, so a search phrase
    finds its titles by an equi join over distinct titles."""
    titles = postings.groupBy(F.lower("title").alias("title")) \
        .agg(F.count(F.lit(1)).alias("rows"))
    words = F.filter(F.split("title", "[^a-z0-9]+"), lambda w: w != "")
    runs = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(words)),
        lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1),
                              lambda n: F.array_join(F.slice(words, i, n), " ")))))
    phrase = F.array_join(F.filter(F.split(F.lower("keywords"), "[^a-z0-9]+"),
                                   lambda w: w != ""), " ")
    spread = titles.filter(F.size(words) > 0) \
        .select(F.explode(runs).alias("phrase"), "rows")
    return plan.withColumn("phrase", phrase).join(spread, "phrase", "left") \
        .groupBy("tier", "keywords", F.coalesce("category", F.lit("")).alias("category")) \
        .agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("postings"))


# How the synthetic employers resolve, per hundred, and the title mix.
SHAPES = [("exact", 55), ("suffix", 12), ("trading_as", 8), ("trap", 10), ("absent", 15)]
TITLE_MIX = [("good", 70), ("senior", 10), ("clearance", 7), ("blocked", 6), ("other", 7)]


def _pick(number, table):
    chain, bound = F, 0
    for name, share in table:
        bound += share
        chain = chain.when(number < bound, name)
    return chain.otherwise(table[-1][0])


def synthetic_shapes(ids: DataFrame, key: str = "id") -> DataFrame:
    """Resolution shape and title group per id; the scale is the number of ids."""
    number = F.pmod(F.col(key) * 7919 + 13, F.lit(100))
    roll = F.pmod(F.col(key) * 7919 + 31, F.lit(100))
    return ids.select(key, _pick(number, SHAPES).alias("shape"),
                      _pick(roll, TITLE_MIX).alias("title_group"))


def synthetic_register(ids: DataFrame, key: str = "id") -> DataFrame:
    """Register rows for synthetic employers plus filler from a disjoint vocabulary."""
    shaped = synthetic_shapes(ids, key)
    name = F.concat(F.lit("Brand"), F.col(key).cast("string"))
    legal = F.concat(F.lit("Holding"), F.col(key).cast("string"))
    orgs = F.when(F.col("shape") == "exact", F.array(name)) \
        .when(F.col("shape") == "suffix", F.array(F.concat(name, F.lit(" UK")))) \
        .when(F.col("shape") == "trading_as",
              F.array(F.concat(legal, F.lit(" Ltd T/A "), name))) \
        .when(F.col("shape") == "trap",
              F.array(F.concat(name, F.lit(" Charitable Trust")),
                      F.concat(name, F.lit(" Capital Partners")))) \
        .otherwise(F.array().cast("array<string>"))
    filler = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(
        F.lit("Filler"), i.cast("string"), F.lit(" Goods "), F.col(key).cast("string")))
    return shaped.select(key, "shape", F.posexplode(F.concat(orgs, filler))
                         .alias("pos", "org"))
