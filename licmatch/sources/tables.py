"""Register, board registry, overlays, posting store and decision log on storage."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from licmatch import rules, schema
from licmatch.functions.text import blank, normalize_name, strip
from licmatch.operators import store as st
from licmatch.operators.audit import flatten_log
from licmatch.operators.frames import first_per_key, number_by_range
from licmatch.operators.shortlist import apply_shortlist, store_keys, store_order
from licmatch.sources.csv_records import read_csv

BOARD_FIELDS = schema.BOARD.fieldNames()


# --- register -------------------------------------------------------------------------------

def read_register(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path)
    return raw.select(
        F.col("`Organisation Name`").alias("org"), F.col("`Town/City`").alias("town_city"),
        F.col("County").alias("county"), F.col("`Type & Rating`").alias("type_rating"),
        F.col("Route").alias("route"), "ord")


def parse_register_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Register rows from CSV lines that already sit in a table."""
    fields = T.StructType([T.StructField(n, T.StringType()) for n in
                           ("org", "town_city", "county", "type_rating", "route")])
    parsed = F.from_csv(F.regexp_replace(line, "^﻿", ""), fields.simpleString()[7:-1]
                        .replace(":", " ").replace(",", ", "), {"escape": '"'})
    return lines.select(*[c for c in lines.columns if c != line],
                        parsed.alias("_row")).select(
        *[c for c in lines.columns if c != line], "_row.*") \
        .filter(F.col("org") != "Organisation Name")


# --- board registry ---------------------------------------------------------------------------

def clean_boards(raw: DataFrame, *keep: str) -> DataFrame:
    """Seven trimmed fields; rows without a slug and commented-out rows are dropped."""
    return raw.filter((strip("slug") != "") & ~F.ltrim(blank("company")).startswith("#")) \
        .select(*[strip(f).alias(f) for f in BOARD_FIELDS], *keep)


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    return clean_boards(read_csv(spark, path).select(*BOARD_FIELDS, "ord"), "ord")


def board_file_order(boards: DataFrame) -> DataFrame:
    return boards.select(*BOARD_FIELDS).orderBy("ats", F.lower("company"))


def write_boards(boards: DataFrame, path: str) -> None:
    board_file_order(boards).write.mode("overwrite").option("header", True).csv(path)


def active_boards(boards: DataFrame, family: str | None = None,
                  slug: str | None = None) -> DataFrame:
    kept = boards.filter(blank("status").isin(*rules.ACTIVE_BOARD_STATUSES))
    if family:
        kept = kept.filter(F.col("ats") == family)
    return kept.filter(F.col("slug") == slug) if slug else kept


def merge_outcomes(boards: DataFrame, outcomes: DataFrame, as_of) -> DataFrame:
    """Fetch outcomes (ats, slug, outcome, note, ord) onto the registry; transient ones change
    nothing, and only a board that answered gets a new last_ok.

    Of several outcomes of one board the last real one counts, and its last note; the board
    has answered if any of them did.
    """
    order = "ord" if "ord" in outcomes.columns else F.lit(0)
    real = outcomes.filter(F.col("outcome") != "transient").groupBy("ats", "slug").agg(
        F.max_by("outcome", order).alias("_outcome"),
        F.max_by(blank("note"), F.when(blank("note") != "", order)).alias("_note"),
        F.bool_or(F.col("outcome").isin("active", "empty")).alias("_answered"))
    joined = boards.join(real, ["ats", "slug"], "left")
    answered = F.coalesce("_answered", F.lit(False))
    return joined.withColumns({
        "status": F.coalesce("_outcome", "status"),
        "last_ok": F.when(answered, F.lit(str(as_of))).otherwise(F.col("last_ok")),
        "notes": F.when(blank("_note") != "", F.col("_note")).otherwise(F.col("notes")),
    }).select(*boards.columns)


# --- overlays ---------------------------------------------------------------------------------

def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def explode_map(raw: DataFrame, text: str, map_type: T.MapType, key: str) -> DataFrame:
    """Rows of a JSON object; malformed text gives none. Keys keep their file order."""
    parsed = F.from_json(F.col(text), map_type)
    rows = raw.select(*[c for c in raw.columns if c != text],
                      F.posexplode(F.map_entries(parsed)).alias("ord", "_e"))
    rest = [c for c in raw.columns if c != text]
    if isinstance(map_type.valueType, T.StructType):
        return rows.select(*rest, F.col("_e.key").alias(key), "_e.value.*",
                           F.col("ord").cast("bigint"))
    return rows.select(*rest, F.col("_e.key").alias(key), F.col("_e.value").alias("value"),
                       F.col("ord").cast("bigint"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    return explode_map(_whole(spark, path), "value", schema.ALIAS_MAP, "company")


def explode_rejections(raw: DataFrame, text: str = "value") -> DataFrame:
    """(key, register_name) pairs; keys are normalised on read, and of several entries that become
    one key the last counts."""
    rows = explode_map(raw.select(F.col(text), F.monotonically_increasing_id().alias("_row")), text,
                       schema.REJECTION_MAP, "company")
    last = rows.groupBy(normalize_name("company").alias("key")).agg(
        F.max_by("value", F.struct("_row", "ord")).alias("value"))
    return last.select("key", F.explode("value").alias("register_name"))


def read_rejections(spark: SparkSession, path: str) -> DataFrame:
    return explode_rejections(_whole(spark, path))


def explode_rulings(raw: DataFrame, text: str = "value") -> DataFrame:
    parsed = raw.select(F.from_json(text, schema.RULING_FILE).alias("_f"))

    def part(kind: str, field: str) -> DataFrame:
        rows = parsed.select(F.posexplode(F.map_entries(F.col("_f")[field]))
                             .alias("ord", "_e"))
        return rows.select(F.lit(kind).alias("kind"), F.col("_e.key").alias("ruling_key"),
                           "_e.value.*", F.col("ord").cast("bigint"))
    return part("company", "companies").unionByName(part("role", "roles"))


def read_rulings(spark: SparkSession, path: str) -> DataFrame:
    return explode_rulings(_whole(spark, path))


def read_closures(spark: SparkSession, path: str) -> DataFrame:
    return explode_map(_whole(spark, path), "value", schema.CLOSURE_MAP, "id")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return explode_map(_whole(spark, path), "value", schema.VERDICT_MAP, "id")


def explode_contacts(raw: DataFrame, text: str = "value") -> DataFrame:
    """Contacts from a JSON list, or an object with a ``contacts`` list."""
    body = F.col(text)
    listed = F.when(F.ltrim(body).startswith("["), body) \
        .otherwise(F.get_json_object(body, "$.contacts"))
    return raw.select(F.posexplode(F.from_json(listed, T.ArrayType(schema.CONTACT)))
                      .alias("ord", "_c")).select("_c.*", F.col("ord").cast("bigint"))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    return explode_contacts(_whole(spark, path))


def write_overlay(table: DataFrame, path: str, key: str) -> None:
    """The exploded overlay, sorted by key, replacing the folder's content."""
    table.orderBy(key).write.mode("overwrite").json(path)


def read_overlay(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """An overlay of any size, as ``write_overlay`` leaves it: one JSON line per entry."""
    return spark.read.schema(columns).json(path)


def overlay_json(table: DataFrame, key: str) -> DataFrame:
    """The overlay as one JSON object, for export of a human-sized overlay."""
    value = F.struct(*[c for c in table.columns if c not in (key, "ord")])
    return table.agg(F.to_json(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct(F.col(key), value.alias("value")))))).alias("value"))


# --- posting store ------------------------------------------------------------------------------

def snapshot_path(root: str, version: str | None = None) -> str:
    return f"{root}/v={version or dt.datetime.now(dt.timezone.utc).strftime('%Y%m%d%H%M%S%f')}"


def write_snapshot(rows: DataFrame, root: str, version: str | None = None) -> str:
    """A full ordered copy in a new version folder; readers see it once it is complete."""
    path = snapshot_path(root, version)
    store_order(rows).write.mode("errorifexists").parquet(path)
    return path


def numbered_snapshot(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Id and ``place`` of every row in the order of a snapshot, from 1."""
    keys = store_keys(order)
    slim = rows.select("id", *[key.alias(f"_key{i}") for i, key in enumerate(keys)])
    return number_by_range(slim, [f"_key{i}" for i in range(len(keys))], "place") \
        .select("place", "id")


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version (Spark writes _SUCCESS last)."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v=*/_SUCCESS")
    done = pattern.getFileSystem(conf).globStatus(pattern)
    versions = sorted(str(s.getPath().getParent()) for s in (done or []))
    if not versions:
        return spark.createDataFrame([], schema.POSTING.add("ord", "bigint"))
    return spark.read.parquet(versions[-1])


def append_new(rows: DataFrame, root: str, batch: str | int) -> None:
    """Insert-only write: one folder per batch; a repeated batch replaces its own folder."""
    rows.write.mode("overwrite").parquet(f"{root}/batch={batch}")


def read_csv_store(spark: SparkSession, path: str) -> DataFrame:
    """Legacy CSV store: keyed by id, last row wins."""
    return first_per_key(st.conform(read_csv(spark, path), "ord"), ["id"], [F.desc("ord")])


def load_store(spark: SparkSession, root: str) -> DataFrame:
    return st.load_rules(latest_snapshot(spark, root))


def shortlist_view(rows: DataFrame) -> DataFrame:
    """The twelve columns of the apply shortlist view."""
    return apply_shortlist(rows).select(*schema.SHORTLIST_VIEW_FIELDS)


# --- decision log -------------------------------------------------------------------------------

def parse_log_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Structured entries; blank and broken lines are skipped. Keeps the raw line."""
    usable = lines.filter(strip(line) != "") \
        .withColumn("_e", F.from_json(line, schema.LOG_ENTRY, {"mode": "PERMISSIVE"}))
    return usable.filter(F.try_parse_json(line).isNotNull() & F.col("_e.seq").isNotNull()) \
        .select("_e.*", F.col(line).alias("raw"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def read_flat_log(spark: SparkSession, path: str) -> DataFrame:
    return flatten_log(read_log(spark, path))


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)
