"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of a word budget by weight, at most ``most`` times its size;
what such a source cannot take goes to the others by weight. Whole epochs of a source come
first. The rest of its target is filled in the order of exponential keys, -ln(u) / weight of
the document's quality, until the running sum of sizes reaches it (the last document is taken
if that comes nearer).

The running sum over a source of any size is found in two steps: sizes are summed per range of
keys, and only the one range of a source in which the target falls is sorted. The result is a
key bound per source, so choosing documents is a filter.

Defined cases: null source is a source of its own, after all others; a null or empty text has
size 0 and takes nothing; u comes from the doc_id, so reruns agree and rows with one doc_id are
chosen alike or in order of size; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from licmatch.llm.frames import stage

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents of a source per range of keys, on average.
RANGE_ROWS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def quality(text: str = "text"):
    """Weight of a document in (0, 1]: lower the more symbols it has per word."""
    symbols = f"char_length({text}) - char_length(translate({text}, '#*$%&|<>', ''))"
    return F.expr(f"1D / (1 + ({symbols}) / greatest(regexp_count({text}, '{_escaped()}'), 1))")


def _escaped() -> str:
    return _WORD.replace("\\", "\\\\")


def _drawn(docs: DataFrame) -> dict:
    """Columns size, source key and exponential key of a row."""
    text = "coalesce(text, '')"
    unit = ("(cast(conv(substr(md5(concat('mix:', coalesce(cast(doc_id as string), ''))), 1, 12),"
            " 16, 10) as double) + 0.5) / 281474976710656D")
    return {"size": F.expr(f"cast(regexp_count({text}, '{_escaped()}') as bigint)"),
            "source": F.expr("if(source is null, '~', concat('=', source))"),
            "key": -F.log(F.expr(unit)) / quality(text)}


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, docs, target) of one row per source (source, source_size, docs).

    Sources reach their limit in the order of size per weight; the level at which the rest is
    shared is the first that leaves the next source below its limit. One row per source is
    ordered in one task here, never documents.
    """
    ranked = sizes.withColumn("nth", F.row_number().over(
        Window.orderBy(F.expr("source = '~'"), "source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("nth") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("most", most * F.col("source_size"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "nth")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(
        Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = ((share * F.sum("source_size").over(every)
              - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after))
    leveled = (ranked.withColumn("level", level)
               .withColumn("place", F.row_number().over(order)))
    fits = F.expr("level * weight <= most")
    return leveled.select(
        "source", "source_size", "docs",
        F.least(F.col("most").cast("double"),
                F.min_by("level", F.when(fits, F.col("place"))).over(every) * F.col("weight"))
        .alias("target"))


def bounds(drawn: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: size, target, whole epochs, ranges of keys and the last key that is taken."""
    sizes = drawn.groupBy("source").agg(F.sum("size").alias("source_size"),
                                        F.count("*").alias("docs"))
    plan = stage(targets(sizes, weights, share, most)
                 .withColumn("epochs", F.expr("if(source_size = 0, 0, "
                                              "cast(floor(target / source_size) as int))"))
                 .withColumn("left", F.expr("target - epochs * source_size"))
                 .withColumn("ranges", F.ceil(F.col("docs") / RANGE_ROWS)))
    placed = drawn.join(plan.select("source", "ranges", "left"), "source") \
        .withColumn("range", key_range())
    ends = placed.groupBy("source", "range", "left").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    last = (ends.withColumn("through", running).where("through > left")
            .groupBy("source").agg(F.min_by(F.struct("range", (F.col("through") - F.col("words"))
                                                     .alias("before")), "range").alias("cut"))
            .select("source", F.col("cut.range").alias("cut_range"), "cut.before"))
    inside = (placed.join(last.withColumnRenamed("cut_range", "range"), ["source", "range"])
              .withColumn("through", F.col("before") + F.sum("size").over(
                  Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    chosen = (inside.where("through - size / 2 <= left")
              .groupBy("source").agg(F.max(F.struct("key", "doc_id", "size")).alias("cut")))
    return plan.join(last.select("source", "cut_range"), "source", "left") \
               .join(chosen, "source", "left")


def key_range():
    """Number of the key's range: equal parts of the keys' distribution at full weight."""
    return F.expr("least(cast(floor((1 - exp(-key)) * ranges) as bigint), ranges - 1)")


def _copies():
    """How often the mix takes a row, given the bounds of its source."""
    inside = F.coalesce(F.struct("key", "doc_id", "size") <= F.col("cut"), F.lit(False))
    more = (F.col("cut_range").isNull() | (key_range() < F.col("cut_range"))
            | ((key_range() == F.col("cut_range")) & inside))
    return F.col("epochs") + F.when(F.col("source_size") == 0, 0).otherwise(more.cast("int"))


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) per row of ``docs``."""
    drawn = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                              *[c.alias(n) for n, c in _drawn(docs).items()]))
    return (drawn.join(bounds(drawn, weights, share, most), "source")
            .withColumn("copies", _copies())
            .select("doc_id", "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).alias("taken"), "copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; rows of size 0 are left out."""
    parts = _drawn(docs)
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        *[c.alias(n) for n, c in parts.items()])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       *[c.alias(n) for n, c in parts.items()])
    return (rows.join(bounds(stage(drawn), weights, share, most), "source")
            .withColumn("copies", _copies()).where("copies > 0 and size > 0")
            .select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*"))


#: The same rule for one row per document: level by level, then a plain running sum.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS symbols,
    (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)
          AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s),
w AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
      FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, nth) AS place FROM w),
l AS (SELECT a.*, (1.5 * (SELECT sum(source_size) FROM o)::DOUBLE
        - coalesce((SELECT sum(2 * source_size) FROM o b WHERE b.place < a.place), 0)::DOUBLE)
        / (SELECT sum(weight) FROM o b WHERE b.place >= a.place) AS level FROM o a),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight *
        (SELECT arg_min(level, place) FROM l WHERE level * weight <= 2 * source_size)) AS target
      FROM l),
k AS (SELECT d.*, t.source_size, t.target,
        CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size) END AS epochs,
        -ln(u) * (1 + symbols / greatest(size, 1)::DOUBLE) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 AS middle FROM k)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END)
       AS BIGINT) AS taken
FROM p
"""
