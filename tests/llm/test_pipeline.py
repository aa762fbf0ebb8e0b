"""The pipeline's stages together, and each stage's contract on small documents."""
from __future__ import annotations

import os
import sys

import pyarrow.parquet as pq
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from licmatch.llm import bpe  # noqa: E402


def table(rows):
    return pa.table({
        "doc_id": pa.array([r[0] for r in rows], pa.int64()),
        "text": pa.array([r[1] for r in rows], pa.string()),
        "lang": pa.array(["en"] * len(rows), pa.string()),
        "source": pa.array([r[2] for r in rows], pa.string()),
        "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})


def test_run(spark, folder, prose):
    line = prose(77, 12)
    rows = [(k, prose(k, 120) + ("\n" + line if k % 3 == 0 else ""), "ab"[k % 2])
            for k in range(24)]
    rows += [(100, prose(1, 120), "a"), (101, prose(2, 120) + " end", "b"),
             (102, "too short", "a"), (103, (prose(3, 30) + "\n") * 9, "b"), (104, None, None)]
    pq.write_table(table(rows), f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(24), 100, 101]
    lines = corpus_pipeline.STAGES[1][1](spark, kept, folder)
    assert lines.columns == docs.columns
    text = {r.doc_id: r.text for r in lines.collect()}
    assert len(text) == 26 and text[100] == "" and text[1] == prose(1, 120)
    assert line in text[0] and all(line not in text[k] for k in range(3, 24, 3))
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    out = corpus_pipeline.run(spark, folder).collect()
    own = bpe.load(bpe.default_path())
    ids = {}
    for r in out:
        assert r.n_tokens == len(r.ids) > 0
        ids.setdefault(r.doc_id, []).append(r.ids)
    # Copies have lost all their lines; the mix takes 150 % of the words, nothing over twice.
    assert set(ids) <= set(range(24)) and all(len(v) <= 2 for v in ids.values())
    assert 30 <= len(out) <= 42
    whole = {k: own.encode_batch([text[k]])[0] for k in ids}
    assert all(len(v[0]) * 4 == len(whole[k]) for k, v in ids.items())


def test_empty_documents(spark, folder):
    pq.write_table(table([]), f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "source mix", "BPE"]
