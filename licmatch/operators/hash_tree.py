"""A hash tree over numbered digests, so that a log of any length is sealed in parallel.

Leaves are the digests of consecutive chunks, numbered from 0. A node of the next level stands
for ``FAN`` consecutive nodes of the one below; its digest is a fold over their digests in
order. Every node has a start, the digest of all that lies before it:

* the first child starts as its parent does; a later child's start is the digest of the parent's
  start and the fold over the siblings before it;
* the top node starts with the genesis link.

Digests go up level by level and starts come down again, each step a ``groupBy`` on
``node div FAN`` with at most ``FAN`` rows a group and one join. No task ever sees more than
``FAN`` digests at once. The number of levels doesn't change any start; it only has to be
large enough, and rows beyond raise an error.

The right edge of a tree (``edge``) is one fold per level. It is all that an append needs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from licmatch import rules
from licmatch.sources.staging import staged

FAN = 256
#: Levels above the leaves unless told otherwise: up to 256^4 leaves, that is 10^12 entries in
#: chunks of 256.
DEPTH = 4


def depth_for(last: int | None) -> int:
    """Levels that a tree with leaves up to number ``last`` needs."""
    depth = 1
    while (last or 0) >= FAN ** depth:
        depth += 1
    return depth


def link(before: Column, text: Column) -> Column:
    """The link after ``before`` and a text."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(before, F.lit("\n"), text), 256))


def _fold(before: Column, digest: Column) -> Column:
    return F.sha2(F.concat(before, digest), 256)


def _folds(items: Column, first: Column) -> Column:
    """Array of (node, before, after): the running fold around each item's digest."""
    begin = F.array(F.struct(F.lit(None).cast("bigint").alias("node"), first.alias("before"),
                             first.alias("after")))

    def extend(done: Column, item: Column) -> Column:
        last = F.element_at(done, -1)["after"]
        return F.concat(done, F.array(F.struct(
            item["node"].alias("node"), last.alias("before"),
            _fold(last, item["digest"]).alias("after"))))
    folded = F.aggregate(items, begin, extend)
    return F.slice(folded, F.lit(2), F.size(folded))


def levels(leaves: DataFrame, depth: int = DEPTH, edge: DataFrame | None = None
           ) -> list[DataFrame]:
    """Level by level (parent, items(node, before, after)) over leaves (node, digest).

    With ``edge`` the leaves continue a tree: the fold of the nodes left of them comes from
    there. Each level, a row per ``FAN`` nodes, is staged, since the next level and the way
    down both read it.
    """
    nodes, out = leaves.select("node", "digest"), []
    for level in range(1, depth + 1):
        grouped = nodes.groupBy(F.expr(f"node div {FAN}").alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("_items"))
        if edge is None:
            grouped = grouped.withColumn("_first", F.lit(""))
        else:
            left = edge.filter(F.col("level") == level).select("parent", "fold")
            grouped = grouped.join(left, "parent", "left") \
                .withColumn("_first", F.coalesce("fold", F.lit("")))
        folds = grouped.select("parent", _folds(F.col("_items"), F.col("_first"))
                               .alias("items"))
        if level == depth:
            folds = folds.withColumn("parent", F.when(F.col("parent") == 0, 0).otherwise(
                F.raise_error(F.lit(f"more than {FAN}^{depth} leaves")).cast("bigint")))
        folds = staged(folds)
        out.append(folds)
        nodes = folds.select(F.col("parent").alias("node"),
                             F.element_at("items", -1)["after"].alias("digest"))
    return out


def starts(leaves: DataFrame, depth: int = DEPTH, edge: DataFrame | None = None) -> DataFrame:
    """(node, start) of every leaf."""
    built = levels(leaves, depth, edge)
    known = built[-1].select("parent", F.lit(rules.GENESIS).alias("_start"))
    for level in range(depth, 0, -1):
        folds = built[level - 1]
        child = folds.join(known, "parent").select(
            F.inline("items"), "_start", "parent").select(
            "node", F.when(F.col("before") == "", F.col("_start"))
            .otherwise(link(F.col("_start"), F.col("before"))).alias("_start"))
        known = child.withColumnRenamed("node", "parent")
    return known.select(F.col("parent").alias("node"), F.col("_start").alias("start"))


def right_edge(leaves: DataFrame, depth: int = DEPTH, edge: DataFrame | None = None
               ) -> DataFrame:
    """(level, parent, fold): per level the fold of the complete nodes below its last parent.

    All leaves given count as complete. With ``edge`` they continue the tree it belongs to.
    """
    following = leaves.select(F.max("node") + 1).scalar()
    rows = None
    for level, folds in enumerate(levels(leaves, depth, edge), 1):
        at = F.expr(f"_next div {FAN ** (level - 1)}")
        one = folds.select("parent", F.inline("items")).withColumn("_next", following) \
            .filter((F.col("parent") == F.expr(f"_next div {FAN ** level}"))
                    & (F.col("node") < at)) \
            .groupBy("parent").agg(F.max_by("after", "node").alias("fold")) \
            .select(F.lit(level).alias("level"), "parent", "fold")
        if edge is not None:  # a level without a new complete node keeps its fold
            same = edge.filter(F.col("level") == level).withColumn("_next", following) \
                .filter(F.col("parent") == F.expr(f"_next div {FAN ** level}")) \
                .select("level", "parent", "fold")
            one = one.unionByName(same.join(one.select("level"), "level", "left_anti"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
