from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from slotledger.llm import ngram_join
from slotledger.llm.graph import components

SPLIT = {"cluster_shingles": 300, "local_run": 2, "region_run": 3, "bucket_entries": 2000, "flush_entries": 3000, "pivots": 3}


def _found(docs, settings=None):
    rows = ngram_join.ngram_components(docs, settings).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


@pytest.mark.parametrize("settings", [{}, SPLIT])
def test_components_equal_all_pairs(awkward, documents, settings):
    for docs in (awkward, documents):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        wanted = sorted(brute.link_components(rows), key=repr)
        assert _found(docs, ngram_join.Settings(**settings)) == wanted


def test_chains_of_near_copies_in_split_clusters(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(60):  # each a small step from the one before
        words[(7 * i) % 100] = f"c{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert _found(docs, ngram_join.Settings(**SPLIT)) == sorted(brute.link_components(rows), key=repr)


def test_passage_shared_by_all_links_nothing(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(100))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(c == d for d, _, c in _found(docs))


def test_rare_shingles_link_members_of_a_wide_region(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for i in range(40):  # 18 rare shingles and one of the passage in the prefix; in the near copy's, none
        own = [f"w{rng.randrange(10**9)}" for _ in range(18)]
        edited = [*passage[:40], f"e{i}", *passage[41:]]
        rows += [(2 * i, " ".join(own + passage)), (2 * i + 1, " ".join(own + edited))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = sorted(brute.link_components(rows), key=repr)
    assert all(c == d - d % 2 for d, _, c in wanted)
    for settings in ({"region_run": 3}, {"local_run": 2}, SPLIT):
        assert _found(docs, ngram_join.Settings(**settings)) == wanted


def test_one_of_each_group_stays(awkward):
    kept = ngram_join.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    linked = {d: c for d, _, c in _found(awkward)}
    assert {i for i in ids if i is not None} == {c for c in linked.values() if c is not None}


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**9)}" for _ in range(30)) for _ in range(5))
    rows = [
        (None, a), (None, a), (None, ""), (None, None), (None, ""), (5, b), (5, b), (5, c), (7, b), (None, c),
        (3, d), (8, d), (8, e), (4, " "), (4, None), (9, e.upper()), (6, f"{a} more"), (None, "alone here"),
    ]
    docs = spark.createDataFrame([(*r, {"at": i}) for i, r in enumerate(rows)], "doc_id long, text string, _id map<string,int>")
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one_of_each(docs.repartition(3)).collect()]
    wanted = [
        (None, ""), (None, ""), (None, None), (5, b), (5, c), (3, d), (8, e), (4, " "), (4, None), (6, f"{a} more"),
        (None, "alone here"),
    ]
    assert sorted(kept, key=repr) == sorted(wanted, key=repr)
    nameless = docs.where("doc_id IS NULL AND text <> ''")
    kept = [r["text"] for r in ngram_join.keep_one_of_each(nameless).collect()]
    assert sorted(kept) == sorted([a, c, "alone here"])


def test_empty_table(no_documents):
    assert _found(no_documents) == []
    assert ngram_join.keep_one_of_each(no_documents).count() == 0


def test_sketches_never_exclude_a_near_pair():
    rng = np.random.default_rng(0)
    for n in (1, 5, 40, 63, 65, 500, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: max(1, n - n // 10)], rng.integers(0, 2**63, n // 12).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            sizes = np.array([len(a), len(b)])
            blobs = [ngram_join.parity_sketch(x).tobytes() for x in (a, b)]
            assert len(set(ngram_join.near_by_sketch(sizes, blobs, 80))) == 1


def test_graph_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5)] + [(100, 100 + i) for i in range(1, 50)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    labels = {r["node"]: r["component"] for r in found}
    assert labels == {**{i: 1 for i in (1, 2, 3, 7, 8, 9)}, 20: 20, 21: 20, **{100 + i: 100 for i in range(50)}}


def test_texts_become_python_objects_a_piece_at_a_time(monkeypatch):
    """A worker holds about PIECE_BYTES of texts as Python bytes, not a whole Arrow batch."""
    import pyarrow as pa

    held = []

    def recorded(texts):
        found = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        held.append(sum(map(len, found)))
        return found

    monkeypatch.setattr(ngram_join, "as_bytes", recorded)
    text = " ".join(f"w{i}" for i in range(ngram_join.PIECE_BYTES // 16))
    n = 8
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(n), pa.int64()), "address": [str(i) for i in range(n)],
        "tie": pa.array([0] * n, pa.int64()), "text": [text] * (n - 1) + [None]})
    rows = [r for b in ngram_join._shapes(5)(iter([batch])) for r in b.to_pylist() if r["block"] is None]
    assert [r["doc_id"] for r in rows] == list(range(n))
    assert len({r["key"] for r in rows[:-1]}) == 1 and rows[-1]["n"] == 0
    assert held and max(held) <= ngram_join.PIECE_BYTES
