from __future__ import annotations

import random

import brute
import pytest

from slotledger.llm import mixing


def _check(docs, near):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.select("doc_id", "source", "text").collect()]
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    assert sorted(r["size"] for r in found) == sorted(len(brute.words(t)) for *_, t in rows)
    sizes, most = {}, {}
    for _, source, text in rows:
        n = len(brute.words(text))
        sizes[source] = sizes.get(source, 0) + n
        most[source] = max(most.get(source, 0), n)
    wanted, taken = brute.shares(sizes), {}
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= near * most[source] + 1e-6


def test_targets_and_takings(awkward, documents):
    _check(documents, 0.51)
    _check(awkward, 1.01)  # a repeated row is taken with its copy


def test_limits_and_resharing(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice("aab")) for i in range(400)]
    rows += [(1000 + i, "w " * 10, s) for i, s in enumerate(["tiny", None, "é", "z"])]
    _check(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.51)


def test_words_are_counted_by_ascii_space(spark):
    texts = [None, "", " ", "a", " a", "a ", "a b c\x0bd\n\ne", "\t", "x\x1fy"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r[0] for r in docs.orderBy("doc_id").select(mixing.word_count(docs.text)).collect()]
    assert got == [len(brute.words(t)) for t in texts]


def test_mixed_documents_repeat_as_taken(awkward):
    mixed = mixing.mixed_documents(awkward)
    assert mixed.columns == awkward.columns
    wanted = {}
    for r in mixing.mix(awkward).where("doc_id IS NOT NULL AND doc_id <> 6").collect():
        if r["copies"]:
            wanted[r["doc_id"]] = r["copies"]
    got = {}
    for r in mixed.where("doc_id IS NOT NULL AND doc_id <> 6").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == wanted


def test_empty_table_and_plan(no_documents, documents):
    assert mixing.mix(no_documents).count() == 0
    assert mixing.mixed_documents(no_documents).count() == 0
    plan = mixing.mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
