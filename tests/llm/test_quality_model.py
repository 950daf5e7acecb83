from __future__ import annotations

import zlib

import numpy as np

from slotledger.llm import quality_model
from slotledger.llm.words import Words


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_model.score_documents(docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])
    assert right >= 0.94
    logits = [-np.log(max(r["score"] if truth[r["doc_id"]] else 1 - r["score"], 1e-9)) for r in held]
    assert np.mean(logits) < 0.25  # calibrated: far below the 0.42 of the base rate


def test_awkward_rows_and_missing_labels(awkward, no_documents, labels):
    none = labels.limit(0)
    rows = quality_model.score_documents(awkward, none).collect()
    assert len(rows) == awkward.count() and {r["score"] for r in rows} == {0.5}
    scored = quality_model.score_documents(awkward, labels).collect()
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert quality_model.score_documents(no_documents, labels).count() == 0


def test_contexts_are_sums_over_neighbours():
    one = np.zeros((quality_model.ROWS, quality_model.DIMENSIONS + 1), np.int64)
    quality_model.add_contexts(Words([b"a b c", b"d", b""]), one)
    parts = np.zeros_like(one)
    for blob in (b"a b c", b"d"):
        quality_model.add_contexts(Words([blob]), parts)
    assert (one == parts).all()
    assert one[:, -1].sum() == 2 * 4  # words and endings
    assert np.abs(one[:, :-1]).sum() <= 2 * 6 * 2  # two entries for each of six ordered pairs


def test_temperature_and_separation():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 8))
    y = (x[:, 0] + 0.3 * rng.normal(size=2000) > 0).astype(float)
    net = quality_model.train(x, y)
    assert np.mean((net.scores(x) > 0.5) == y) > 0.9
