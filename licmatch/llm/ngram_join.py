"""N-gram Jaccard join by prefix trees.

Sets of word n-grams are put in one global order, rarer grams first. Two sets that are similar
enough share a gram of their prefixes, so only documents meeting at such a gram are compared.
A comparison puts the sets that one probe may link with into a prefix tree and walks it once:
documents with the same beginning share the overlap counted so far, and a subtree is left as
soon as its remaining length cannot bring the overlap to what its smallest set needs.

First the documents go that cannot link: of each set so many first grams are taken that a linked
set has several of them, and those that have too few grams in common with any other set are left
out. The rest is ordered anew by how many of its sets have a gram, counted exactly.

Groups may be of any size. Equal sets are one node. In a few rounds each gram's documents are
compared with one leader of the gram; after that only documents of different components are,
so a large family of near copies costs a few comparisons per member to come together. All links
between different sets lie inside components. They are counted there, blocks of a component
against each other, each block in a tree; only the counts leave the tasks.

Defined cases: letters A-Z count as a-z; a text of fewer words than n is one gram, a text
without words (or null) has no grams and no links; rows with one doc_id are one node, rows
without doc_id likewise (their component is null if nothing smaller is reached). Every input
row gives one output row. Grams are told apart by 56 bits of a 64-bit hash.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from licmatch.llm import words as W
from licmatch.llm.frames import NO_ID, components, drop_staged, public_id, stage, texts

#: Counters of the gram sketch: 2**22 of them, whatever the corpus size (4 MB as levels).
SKETCH_BITS = 22
_CHUNK = 1 << 16
#: Sets put in one prefix tree at most, about; a probe with more partners, or a component with
#: more members, is split, a component also by the number of its grams.
TREE_SETS = 256
TREE_GRAMS = 1 << 19
#: One more gram is taken of a set for each of so many that it has.
SPARE = 8
#: Rounds in which documents are compared with leaders only, before what is left.
LEADER_ROUNDS = 2


def needed(n_a, n_b, percent: int):
    """Smallest overlap of linked sets: 100 * overlap >= percent * (n_a + n_b - overlap)."""
    return -((-percent * (n_a + n_b)) // (100 + percent))


# -- global order ----------------------------------------------------------------------------

def gram_levels(docs: DataFrame, n: int) -> np.ndarray:
    """Magnitude (floor of log2) of how often grams of each sketch cell occur in all texts.

    Tasks count into cells, the cells' counts are added up by cell range, and only the levels
    (one byte a cell) reach the driver. A level orders grams; it never decides a link.
    """
    def count(batches: Iterator[pa.RecordBatch]):
        cells = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for _, data, offsets in W.parts(batch):
                words = W.hash_words(data, offsets, lower=True)
                grams = [g for g in W.shingles(words, n) if len(g)]
                if grams:
                    at = (np.concatenate(grams) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    cells += np.bincount(at, minlength=len(cells)).astype(np.uint32)
        press = zstandard.ZstdCompressor(level=1).compress
        for k in range(0, len(cells), _CHUNK):
            piece = cells[k:k + _CHUNK]
            if piece.any():
                yield pa.record_batch({"piece": pa.array([k // _CHUNK], pa.int32()),
                                       "counts": pa.array([press(piece.tobytes())], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for piece, counts in zip(batch["piece"].to_pylist(), batch["counts"]):
                counts = np.frombuffer(unpress(counts.as_py()), dtype=np.uint32)
                if piece in sums:
                    sums[piece] += counts
                else:
                    sums[piece] = counts.astype(np.uint64)
        for piece, counts in sums.items():
            level = np.floor(np.log2(counts + 1.0)).astype(np.uint8)
            yield pa.record_batch({"piece": pa.array([piece], pa.int32()),
                                   "levels": pa.array([level.tobytes()], pa.binary())})

    pieces = (1 << SKETCH_BITS) // _CHUNK
    rows = (docs.select("text").mapInArrow(count, "piece int, counts binary")
            .repartition(pieces, "piece").mapInArrow(add, "piece int, levels binary").collect())
    levels = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for row in rows:
        levels[row.piece * _CHUNK:(row.piece + 1) * _CHUNK] = np.frombuffer(row.levels, np.uint8)
    return levels


def ordered_sets(words: W.Words, n: int, levels: np.ndarray) -> Iterator[np.ndarray]:
    """Per text its distinct grams as numbers whose order is the global order."""
    for grams in W.shingles(words, n):
        level = levels[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        yield np.unique((level.astype(np.int64) << 56) | (grams >> np.uint64(8)).astype(np.int64))


# -- candidates ------------------------------------------------------------------------------

def set_table(docs: DataFrame, n: int, percent: int, levels, whole: bool = False) -> DataFrame:
    """(doc_id, n, key, grams): size, content key and first grams, or all, of each text's set."""
    def table(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, data, offsets in W.parts(batch):
                words = W.hash_words(data, offsets, lower=True)
                size, key, first, ends = [], [], [], [0]
                for grams in ordered_sets(words, n, levels.value):
                    least = -((-percent * len(grams)) // 100)
                    size.append(len(grams))
                    key.append(xxhash.xxh3_128_digest(grams.tobytes()))
                    first.append(grams if whole else
                                 grams[:len(grams) - least + 1 + len(grams) // SPARE])
                    ends.append(ends[-1] + len(first[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                 pa.array(np.concatenate(first)))
                yield pa.record_batch({"doc_id": part["doc_id"], "n": pa.array(size, pa.int64()),
                                       "key": pa.array(key, pa.binary()), "grams": lists})

    return docs.mapInArrow(table, "doc_id long, n long, key binary, grams array<long>")


def _least(n: str, percent: int) -> str:
    """Size of the smallest set that a set of n grams links with."""
    return f"(({percent} * {n} + 99) div 100)"


def may_link(firsts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(key, node) of the ``classes`` whose sets may link with a different one.

    Of two linked sets the one whose first grams end lower has at least 1 + n div ``SPARE`` of
    these, or the least overlap, in the other, where they are among the first grams too. A set
    that has fewer grams which another set has among its first ones links with none.
    """
    met = Window.partitionBy("gram")
    found = (firsts.select(F.xxhash64("key").alias("class"), F.explode("grams").alias("gram"))
             .withColumns({"lo": F.min("class").over(met), "hi": F.max("class").over(met)})
             .where("lo < hi").groupBy("class").agg(F.count("*").alias("rows")))
    least = _least("n", percent)
    # Each copy of a set gave its rows.
    return (classes.withColumn("class", F.xxhash64("key")).join(found, "class")
            .where(F.expr(f"rows >= copies * least(1 + {least} div {SPARE},"
                          f" {_least(least, percent)})"))
            .select("key", "node"))


def _may_link(percent: int):
    """Sizes and misses allow the overlap needed by two documents that meet at a gram.

    Both prefixes reach that gram, so a gram before it that no other prefix holds is missing
    in the partner: each side's misses leave it only so many grams to share.
    """
    need = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    return ((F.col("n_a") - F.col("missed_a") >= need)
            & (F.col("n_b") - F.col("missed_b") >= need))


def meeting_grams(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, missed, at): documents at every prefix gram that more than one has.

    Grams that fewer sets have come first. ``at`` counts the document's grams before this one,
    ``missed`` those of them that no other prefix has.
    """
    met = Window.partitionBy("gram")
    grams = (sets.select("node", F.xxhash64("key").alias("class"), "n",
                         F.explode("grams").alias("gram"))
             .withColumn("sets", F.count("*").over(met)))
    own = Window.partitionBy("class").orderBy("sets", "gram")
    prefix = (grams.withColumn("at", F.row_number().over(own) - 1)
              .where(F.expr(f"sets > 1 and at <= n - {_least('n', percent)}")))
    live = (prefix.withColumn("held", F.count("*").over(met)).where("held > 1")
            .withColumn("missed", (F.col("at") - F.row_number().over(own) + 1).cast("long")))
    return stage(live.select("gram", "node", "n", "missed", "at"))


def _label(live: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``live`` with each node's component so far."""
    if parts is None:
        return live.withColumn("component", F.col("node"))
    return live.join(parts, "node", "left").select(
        "gram", "node", "n", "missed", "at", F.coalesce("component", "node").alias("component"))


def _mixed(labelled: DataFrame, *more) -> DataFrame:
    """Grams at which several components meet."""
    return (labelled.groupBy("gram")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *more)
            .where("lo < hi").drop("lo", "hi"))


def meeting_early(labelled: DataFrame, percent: int) -> DataFrame:
    """(a, b) of nodes of different components that meet at a gram early enough in both sets.

    What stands before the first gram that two sets share is in neither's partner, so for a link
    each set must still have the overlap needed from that gram on.
    """
    apart = labelled.join(_mixed(labelled).select("gram"), "gram", "left_semi") \
        .select("gram", "node", "n", "at", "component")
    need = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    return (apart.toDF("gram", "a", "n_a", "at_a", "of_a")
            .join(apart.toDF("gram", "b", "n_b", "at_b", "of_b"), "gram")
            .where("a < b and of_a <> of_b")
            .where((F.col("n_a") - F.col("at_a") >= need) & (F.col("n_b") - F.col("at_b") >= need))
            .select("a", "b").distinct())


# -- comparison ------------------------------------------------------------------------------

class _Tree:
    """A prefix tree over sorted sets in compressed form: one segment between branchings.

    Children without children of their own are kept side by side in one array.
    """

    __slots__ = ("segment", "children", "ends", "least", "deepest", "leaves", "tails", "starts",
                 "sizes")

    def __init__(self, sets: list[tuple[int, np.ndarray]], depth: int):
        """``sets`` (id, grams) in lexicographic order, equal in their first ``depth`` grams."""
        self.least = min(len(g) for _, g in sets)
        self.deepest = max(len(g) for _, g in sets)
        first, last = sets[0][1], sets[-1][1]
        end = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:end] != last[depth:end])
        stop = depth + int(differ[0]) if len(differ) else end
        self.segment = first[depth:stop]
        self.ends = [node for node, g in sets if len(g) == stop]
        self.children, self.leaves, tails = [], [], []
        rest = [x for x in sets if len(x[1]) > stop]
        lo = 0
        for hi in range(1, len(rest) + 1):
            if hi == len(rest) or rest[hi][1][stop] != rest[lo][1][stop]:
                if hi - lo == 1:
                    self.leaves.append(rest[lo][0])
                    tails.append(rest[lo][1][stop:])
                else:
                    self.children.append(_Tree(rest[lo:hi], stop))
                lo = hi
        if tails:
            lengths = np.array([len(t) for t in tails])
            self.tails, self.sizes = np.concatenate(tails), lengths + stop
            self.starts = np.cumsum(lengths) - lengths


def _walk(tree: _Tree, probe: np.ndarray, marks: np.ndarray, percent: int) -> Iterator[int]:
    """Ids of the sets in the tree that link with the probe, whose grams are marked."""
    stack = [(tree, 0, 0, 0)]
    size = len(probe)
    while stack:
        node, depth, overlap, at = stack.pop()
        if len(node.segment):
            at = int(np.searchsorted(probe, node.segment[-1], side="right"))
            overlap += int(np.count_nonzero(marks[node.segment]))
            depth += len(node.segment)
        for found in node.ends:
            if overlap >= needed(size, depth, percent):
                yield found
        if node.leaves:
            need = needed(size, node.sizes, percent)
            if (overlap + np.minimum(node.sizes - depth, size - at) >= need).any():
                shared = overlap + np.add.reduceat(marks[node.tails], node.starts, dtype=np.int64)
                for i in np.flatnonzero(shared >= need).tolist():
                    yield node.leaves[i]
        for child in node.children:
            more = min(child.deepest - depth, size - at)
            if overlap + more >= needed(size, child.least, percent):
                stack.append((child, depth, overlap, at))


def _links_of_group(probes: list, members: list, percent: int) -> list[list[int]]:
    """Per probe (sorted grams) the ids of the ``members`` (id, sorted grams) it links with."""
    every = [*probes, *(g for _, g in members)]
    # Places in the order instead of grams, so that marks fit an array.
    names, places = np.unique(np.concatenate(every), return_inverse=True)
    ends = np.cumsum([len(g) for g in every])
    every = np.split(places, ends[:-1])
    probes, grams = every[:len(probes)], every[len(probes):]
    tree = _Tree(sorted(((x, g) for (x, _), g in zip(members, grams)),
                        key=lambda x: x[1].astype(">i8").tobytes()), 0)
    marks, links = np.zeros(len(names), dtype=bool), []
    for probe in probes:
        marks[probe] = True
        links.append(list(_walk(tree, probe, marks, percent)))
        marks[probe] = False
    return links


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """Grams of a column of lists."""
    ends = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[ends[0]:ends[-1]], ends[1:-1] - ends[0])


def _groups(batches: Iterator[pa.RecordBatch], key: list[str], values: list[str]) -> Iterator:
    """(key, rows) of runs of rows with one key; a row is its ``values`` and its grams."""
    now, rows = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        for group, row, grams in zip(zip(*(batch[c].to_pylist() for c in key)),
                                     zip(*(batch[c].to_pylist() for c in values)),
                                     _arrays(batch["grams"])):
            if group != now:
                if rows:
                    yield now, rows
                now, rows = group, []
            rows.append((*row, grams.copy()))
    if rows:
        yield now, rows


def linked_pairs(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs (a, b) whose sets are similar enough; a is the probe."""
    def compare(batches: Iterator[pa.RecordBatch]):
        for (probe, _), rows in _groups(batches, ["probe", "slot"], ["partner"]):
            probes = [g for x, g in rows if x is None]
            members = [(x, g) for x, g in rows if x is not None]
            if probes and members:
                found = sorted(set().union(*_links_of_group(probes, members, percent)))
                yield pa.record_batch({"a": pa.array([probe] * len(found), pa.int64()),
                                       "b": pa.array(found, pa.int64())})

    slots = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(TREE_SETS / 2)).alias("slots"))
    dealt = stage(pairs.join(slots, "a").select(
        F.col("a").alias("probe"), F.col("b").alias("partner"),
        F.pmod(F.xxhash64("b"), "slots").alias("slot")))
    grams = sets.select("node", "grams")
    rows = (dealt.join(grams, F.col("partner") == F.col("node"))
            .select("probe", "slot", "partner", "grams")
            .unionByName(dealt.select("probe", "slot").distinct()
                         .join(grams, F.col("probe") == F.col("node"))
                         .select("probe", "slot", F.lit(None).cast("long").alias("partner"),
                                 "grams")))
    found = stage(rows.repartition("probe", "slot").sortWithinPartitions("probe", "slot", "partner")
                  .mapInArrow(compare, "a long, b long"))
    drop_staged(dealt)
    return found


def link_counts(sets: DataFrame, classes: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(key, linked): rows of the ``classes`` whose set is another one that the key's links with.

    ``sets`` has all sets that may link, ``parts`` the components of their nodes.
    """
    def count(batches: Iterator[pa.RecordBatch]):
        for (_, low, high), rows in _groups(batches, ["part", "low", "high"],
                                            ["block", "key", "copies"]):
            ours = [i for i, r in enumerate(rows) if r[0] == low]
            theirs = [i for i, r in enumerate(rows) if r[0] == high]
            if not ours or not theirs:
                continue
            linked = [0] * len(rows)
            found = _links_of_group([rows[i][3] for i in ours], [(i, rows[i][3]) for i in theirs],
                                    percent)
            for i, others in zip(ours, found):
                for j in others:
                    if i != j:
                        linked[i] += rows[j][2]
                        if low != high:
                            linked[j] += rows[i][2]
            some = [i for i, x in enumerate(linked) if x]
            yield pa.record_batch({"key": pa.array([rows[i][1] for i in some], pa.binary()),
                                   "linked": pa.array([linked[i] for i in some], pa.int64())})

    member = (sets.select("node", "key", "n").join(classes.select("key", "copies"), "key")
              .join(parts, "node", "left")
              .select("key", "copies", "n", F.coalesce("component", "node").alias("part")))
    blocks = (member.groupBy("part").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
              .where("sets > 1").select("part", F.expr(
                  f"greatest((sets - 1) div {TREE_SETS} + 1, (grams - 1) div {TREE_GRAMS} + 1)")
                  .alias("blocks")))
    dealt = (member.join(blocks, "part")
             .withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
             .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
             .select("key", "copies", "part", "block", F.least("block", "other").alias("low"),
                     F.greatest("block", "other").alias("high")))
    return (sets.select("key", "grams").join(dealt, "key")
            .repartition("part", "low", "high").sortWithinPartitions("part", "low", "high")
            .mapInArrow(count, "key binary, linked long")
            .groupBy("key").agg(F.sum("linked").alias("linked")))


# -- the join --------------------------------------------------------------------------------

def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.75) -> DataFrame:
    """(doc_id, n_shingles, component_id, copies, n_links) per row of ``docs``.

    ``component_id`` is the least doc_id that can be reached over links (Jaccard similarity of
    at least ``threshold``, in whole percent), ``copies`` the number of rows with an equal set,
    ``n_links`` the number of other rows whose set links with the row's, equal ones included.
    """
    percent = round(100 * threshold)
    docs = texts(docs)
    context = docs.sparkSession.sparkContext
    levels = context.broadcast(gram_levels(docs, n))
    firsts = stage(set_table(docs, n, percent, levels))
    rows = stage(firsts.select("doc_id", "n", "key"))
    classes = stage(rows.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"),
                                            F.count("*").alias("copies")))
    likely = stage(may_link(firsts.where("n > 0"), classes, percent))
    drop_staged(firsts)
    sets = stage(
        set_table(docs.join(likely.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"),
                  n, percent, levels, whole=True).withColumnRenamed("doc_id", "node")
        .join(likely, ["key", "node"])
        .groupBy("key", "node").agg(F.first("n").alias("n"), F.first("grams").alias("grams")))
    live = meeting_grams(sets, percent)

    # Every document against one leader of each gram it meets others at. A family whose members
    # do not all link with one leader comes together over the leaders of a few rounds.
    tried, links, parts = None, None, None
    for seed in range(LEADER_ROUNDS):
        labelled = stage(_label(live, parts)).drop("at")
        leaders = (_mixed(labelled, F.min_by("node", F.xxhash64("node", F.lit(seed)))
                          .alias("node")).join(labelled, ["gram", "node"])
                   .toDF("gram", "a", "n_a", "missed_a", "of_a"))
        pairs = stage(leaders.join(labelled.toDF("gram", "b", "n_b", "missed_b", "of_b"), "gram")
                      .where("a <> b and of_a <> of_b").where(_may_link(percent))
                      .select("a", "b").distinct())
        drop_staged(labelled)
        found = linked_pairs(sets, pairs, percent)
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        parts = components(links)

    # What is left: documents of different components at one gram.
    labelled = stage(_label(live, parts))
    drop_staged(live)
    near = stage(meeting_early(labelled, percent))
    rest = near.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")),
                     ["a", "b"], "left_anti")
    drop_staged(labelled)
    parts = components(links.union(linked_pairs(sets, stage(rest), percent)))
    counts = stage(link_counts(sets, classes, parts, percent))
    drop_staged(sets)

    of_class = (classes.join(parts, "node", "left").join(counts, "key", "left").select(
        "key", "copies", F.coalesce("component", "node").alias("class_component"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("linked")))
    # Texts without grams share a key but no link.
    return (rows.join(of_class, "key").select(
        public_id(), F.col("n").alias("n_shingles"),
        F.expr("nullif(if(n = 0, doc_id, least(doc_id, class_component)), 9223372036854775807)")
        .alias("component_id"), F.expr("if(n = 0, 1, copies)").alias("copies"),
        F.expr("if(n = 0, 0, linked)").alias("n_links")))


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.75) -> DataFrame:
    """``docs`` with one row of each group of equal or linked texts: one of its smallest doc_id.

    Here every text is a node of its own, so rows that share a doc_id, or have none, are not one
    for that; rows without doc_id come last in their group. Rows whose text has no grams all
    stay.
    """
    own = docs.withColumn("_node", F.xxhash64(F.col("text").cast("string")))
    has_words = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()]

    def first_of(rows: DataFrame, key: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(key).orderBy(*first))
        return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")

    unique = stage(first_of(own.where(has_words), "_node"))
    groups = ngram_join(unique.select(F.col("_node").alias("doc_id"), "text"), n, threshold)
    kept = first_of(unique.join(groups.select(F.col("doc_id").alias("_node"),
                                              F.col("component_id").alias("_group")), "_node"),
                    "_group")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*names).union(docs.where(~has_words))
