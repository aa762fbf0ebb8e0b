"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256). The ledger, a folder of Parquet
files, holds for each blob and rule version what was found. A scan looks only at blobs that the
ledger has not seen under the rules' version, one text of each; findings are then joined back to
all paths that ever had the blob. A change of the rules changes their version, so that all
blobs count as unseen.

All work is DataFrame expressions. A blob that very many paths have is scanned once; joining
back, it is a skewed key that Spark splits (the ledger has one row of it).

Defined cases: null text is the empty blob; every row gives one row; places count code points.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from licmatch.llm.frames import NO_ID, public_id, shared_folder
from licmatch.llm.spans import count_of, listed, pieces, spans

#: The rules: kind, fixed pattern, a string it needs. The last one is no base rule.
RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
               r"""[A-Za-z0-9+/_.=-]++""", None),
    ("access", r"AKIA[A-Z0-9]{16,}+", "AKIA"),
    ("hex", r"[0-9a-f]{24,}+", None),
    ("pem", r"-----BEGIN [A-Z ]*+(?<= PRIVATE KEY)-----", "PRIVATE KEY-----"),
]
KINDS = [kind for kind, _, _ in RULES]
BASE = ["assign", "access", "hex"]
_VALUE = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
LEDGER = "blob string, rules string, found array<struct<start:int,kind:int,end:int>>"


def rules_version() -> str:
    return hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]


def _valid(kind: int):
    if KINDS[kind] == "assign":
        return lambda s: F.char_length(F.regexp_extract(s["body"], _VALUE, 1)) >= 6
    return lambda s: F.lit(True)


def _place(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, rules, found) of (blob, text)."""
    cut = blobs.select("blob", *[pieces("text", p, needs).alias(f"cut{k}")
                                 for k, (_, p, needs) in enumerate(RULES)])
    found = [F.transform(F.filter(spans(f"cut{k}", k), _valid(k)), _place)
             for k in range(len(RULES))]
    return cut.select("blob", F.lit(rules_version()).alias("rules"),
                      F.concat(*found).cast("array<struct<start:int,kind:int,end:int>>")
                      .alias("found"))


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, text): every row is a version of the path that its doc_id names."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.sha2(text, 256).alias("blob"), text.alias("text"))


def update(docs: DataFrame, ledger: str) -> DataFrame:
    """Scan what the ledger has not seen, append it, and return the ledger of these rules."""
    spark = docs.sparkSession
    rows = versions(docs)
    seen = read(spark, ledger)
    unseen = (rows.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
              .join(seen.select("blob"), "blob", "left_anti"))
    # One row of each unseen blob; equal rows of one doc_id give equal findings.
    bodies = rows.join(unseen.select("doc_id", "blob"), ["doc_id", "blob"], "left_semi")
    scan(bodies).dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    return read(spark, ledger)


def read(spark, ledger: str) -> DataFrame:
    """The ledger's rows of the present rules, one per blob; an absent ledger is empty.

    A blob may be in the ledger twice, from two writers or a batch that was run again.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger).where(
        F.col("rules") == rules_version()).dropDuplicates(["blob"])


def secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of ``docs``.

    Without a ledger a new one is begun in the shared folder.
    """
    known = update(docs, ledger or shared_folder(docs.sparkSession))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return (versions(docs).select("doc_id", "blob").join(known, "blob")
            .withColumn("base", base).select(
                public_id(), *[count_of(F.col("base"), k).alias(f"n_{name}")
                               for k, name in enumerate(BASE)],
                F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
                listed(F.col("found"), KINDS).alias("spans")))
