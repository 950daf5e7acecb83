from __future__ import annotations

import brute

import corpus_pipeline
from slotledger.llm import queries


def _through(spark, docs, sf, names):
    for name, stage in corpus_pipeline.STAGES:
        if name in names:
            docs = stage(spark, docs, sf)
    return docs


def test_each_stage_does_its_part(spark, documents, sf):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "personal_data", "mix", "encode"]
    good = stages["quality"](spark, documents, sf).cache()
    assert good.columns == documents.columns
    for r in good.collect():
        n, _, _, _, repeated = brute.rule_counts(r["text"])
        assert n >= 20 and 100 * repeated <= 30 * n
    single = stages["near_duplicates"](spark, good, sf).cache()
    linked = brute.link_components([(r["doc_id"], r["text"]) for r in good.collect()])
    assert {r["doc_id"] for r in single.collect()} == {c for _, _, c in linked}
    clean = stages["personal_data"](spark, single, sf).cache()
    assert clean.count() == single.count() and not any(brute.spans(r["text"]) for r in clean.collect())
    mixed = stages["mix"](spark, clean, sf).cache()
    assert mixed.columns == documents.columns
    sizes, taken = {}, {}
    for r in clean.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(brute.words(r["text"]))
    most = max(len(brute.words(r["text"])) for r in clean.collect())
    assert all(abs(taken.get(s, 0) - t) <= most for s, t in brute.shares(sizes).items())
    coded = stages["encode"](spark, mixed, sf).collect()
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in coded) == sorted(
        (r["doc_id"], brute.sha(r["text"])) for r in mixed.collect()
    )


def test_awkward_documents_pass_through(spark, awkward, no_documents, sf):
    for docs in (awkward, no_documents):
        narrow = docs.select("doc_id", "text", "lang", "source", "n_chars")
        _through(spark, narrow, sf, dict(corpus_pipeline.STAGES)).collect()


def test_run_is_the_stages_in_order(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_one_query_for_each_operator():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
