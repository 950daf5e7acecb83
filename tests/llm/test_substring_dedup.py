from __future__ import annotations

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from slotledger.llm import substring_dedup


def _found(docs, settings=None):
    rows = substring_dedup.remove_repeats(docs, settings).collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("settings", [
    {}, {"flush_windows": 500, "bucket_windows": 700, "seed": 5},
    {"flush_windows": 500, "bucket_windows": 700, "hot_runs": 2},
    {"flush_windows": 500, "bucket_windows": 9000, "hot_runs": 10**9, "bucket_bound": 300}])
def test_equals_window_by_window(awkward, documents, settings):
    for docs in (awkward.dropDuplicates(["doc_id"]), documents):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        wanted = sorted(brute.without_repeats(rows), key=repr)
        assert _found(docs, substring_dedup.Settings(**settings)) == wanted


def test_repeated_rows_do_not_remove_each_other(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert [(r[0], r[2]) for r in _found(docs)] == [(1, 0), (1, 0), (2, 30)]


@pytest.mark.parametrize("doc_id", [1, None])
def test_repeated_short_rows_before_a_passage_shared_across_tasks(spark, doc_id):
    short, passage = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("s", 20), ("p", 60)))
    rows = [(doc_id, short), (doc_id, short), (2, f"a {passage}"), (3, f"b {passage}"), (4, "c"), (5, "d")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert [len(part) for part in docs.rdd.glom().collect()] == [3, 3]
    removed = [(i, n) for i, _, n, _ in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(removed, key=repr) == sorted([(doc_id, 0), (doc_id, 0), (2, 0), (3, 60), (4, 0), (5, 0)], key=repr)


def test_each_window_of_repeated_rows_has_its_bit():
    text = " ".join(f"w{i}" for i in range(20)).encode()
    cut = substring_dedup.Settings()
    document, start, offset, seed, own = substring_dedup.windows_of([text, text, text], cut)
    same = np.zeros(len(start), np.int64)
    runs, hashes = substring_dedup._packed(same, same, start, offset, seed, own, substring_dedup.RUN)
    assert np.bitwise_count(runs["mask"]).sum() == len(hashes) == 3


def _hot_phrase(documents):
    """A phrase of 8 words in each document, with other neighbours; every tenth text comes twice."""
    phrase = " ".join(f"hot{i}" for i in range(8))
    for i in range(documents):
        j = i // 2 if i % 10 == 1 else i
        yield i, " ".join(f"l{j}x{n}" for n in range(14)) + f" {phrase} " + " ".join(f"r{j}x{n}" for n in range(14))


@pytest.mark.parametrize("settings", [{"flush_windows": 4000}, {"flush_windows": 900, "hot_runs": 10**9, "bucket_bound": 800}])
def test_windows_of_a_hot_phrase_are_dealt_by_their_own_hash(spark, settings):
    rows = list(_hot_phrase(600))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert _found(docs, substring_dedup.Settings(**settings)) == sorted(brute.without_repeats(rows), key=repr)


@pytest.mark.parametrize("hot_runs", [64, 10**9])
def test_a_hot_phrase_in_very_many_documents_fills_no_bucket(hot_runs):
    """100,000 documents with one phrase: what a bucket of the first round keeps stays bounded, and
    the second round's buckets are even."""
    cut = substring_dedup.Settings(hot_runs=hot_runs, bucket_bound=20_000, flush_windows=1 << 16)
    buckets = 50
    send, meet = substring_dedup._seeds(cut, buckets), substring_dedup._meet_seeds(cut, buckets)
    ids, texts = zip(*_hot_phrase(100_000), strict=True)
    source = (
        pa.RecordBatch.from_pydict({"doc": pa.array(ids[i : i + 5000]), "text": pa.array(texts[i : i + 5000])})
        for i in range(0, len(ids), 5000)
    )
    sent = pa.Table.from_batches(send(source))
    first, second = {}, {}
    for bucket, kind, own in zip(*(sent[n].to_pylist() for n in ("bucket", "kind", "own")), strict=True):
        if kind == substring_dedup.RUNS:
            first[bucket] = first.get(bucket, 0) + len(own) // 6
    hot = max(first, key=first.get)
    assert (max(first.values()) > 5 * sorted(first.values())[25]) == (hot_runs == 10**9)
    rows = sent.filter(pa.compute.equal(sent["bucket"], hot)).to_batches(1000)
    for batch in meet(iter(rows)):
        for bucket, kind, own in zip(*(batch[n].to_pylist() for n in ("bucket", "kind", "own")), strict=True):
            if kind == substring_dedup.SINGLE:
                second[bucket] = second.get(bucket, 0) + len(own) // 6
    passed_by = sum(map(len, sent.filter(pa.compute.equal(sent["kind"], substring_dedup.SINGLE))["own"].to_pylist()))
    assert passed_by + sum(second.values()) > 100_000
    if hot_runs == 10**9:
        assert first[hot] - sum(second.values()) <= cut.bucket_bound
        assert max(second.values()) < 3 * sum(second.values()) / buckets


def test_windows_with_equal_mixed_keys_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_keys", lambda seed, own: np.zeros(len(seed), np.uint64))
    seed = np.array([1, 1, 2, 1, 1], np.uint64)
    own = np.array([5, 6, 5, 5, 5], np.uint64) << np.uint64(16)
    doc = np.array([9, 8, 7, 3, 9])
    later, again = substring_dedup._not_first(seed, own, (doc,))
    assert later.tolist() == [True, False, False, False, True]
    assert again.tolist() == [False, False, False, False, True]


def test_kept_text(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a {passage}"), (2, f"b\n{passage} c")], "doc_id long, text string")
    out = substring_dedup.remove_repeats(docs, with_text=True)
    assert {r["doc_id"]: r["kept_text"] for r in out.collect()} == {1: f"a {passage}", 2: "b c"}


def test_empty_table(no_documents):
    assert _found(no_documents) == []
