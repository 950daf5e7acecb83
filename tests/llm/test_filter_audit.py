from __future__ import annotations

import itertools
import random

import brute
from brute import prose

from slotledger.llm import filter_audit, word_ids


def _fails(text: str, doc_id, firsts: dict) -> set:
    w = brute.words(text)
    found = {
        "A": len(w) < 100,
        "B": 100 * len(set(w)) < 80 * len(w),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and text in firsts and firsts[text] < doc_id,
    }
    return {f for f, failed in found.items() if failed}


def _brute(docs, labels):
    firsts: dict = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            firsts[text or ""] = min(firsts.get(text or "", doc_id), doc_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts: dict = {}
    for doc_id, text, lang in docs:
        parts.setdefault(lang or "", []).append((_fails(text or "", doc_id, firsts), doc_id in good, doc_id in toxic))
    out = []
    for part, rows in parts.items():
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                failing = sum(f in r[0] for r in rows)
                alone = sum(r[0] == {f} for r in rows)
                kept = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                steps.append([part, "".join(order), step, len(kept), len(gone), failing - len(gone), alone,
                              sum(r[1] for r in gone), sum(r[2] for r in gone), f])
                left = kept
        out += [(*row[:-1], shapley[row[-1]]) for row in steps]
    return sorted(out)


def _found(docs, labels):
    df = filter_audit.audit(docs, labels)
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                          "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in df.collect())


def test_awkward_documents(spark, awkward):
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 20, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in awkward.collect()]
    assert _found(awkward, frame) == _brute(docs, labels)


def test_copies_ties_and_missing_values(spark, monkeypatch):
    monkeypatch.setattr(word_ids, "SHARD_BYTES", 4000)
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (40, 99, 100, 160)] + ["A" * 10 + "b" * 90, "A" * 11 + "b" * 89, "", None, "# " * 120]
    texts += [f"{texts[3]} $", texts[3].upper(), " ".join(["é"] * 20 + prose(rng, 80).split())]
    docs = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(200)]
    docs += [(None, texts[0], "en"), (None, texts[0], "fr"), (3, docs[3][1], "en"), (3, docs[3][1], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert _found(frame, told) == _brute(docs, labels)


def test_no_documents(spark, no_documents, labels):
    assert _found(no_documents, labels) == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = _found(one, none)
    assert len(rows) == 600 and {r[0] for r in rows} == {""}


def test_matrix_has_one_column_a_word(spark, documents):
    shards = filter_audit.matrix_shards(documents)
    rows = word_ids.Dictionary(shards).words().collect()
    assert sorted(r["id"] for r in rows) == list(range(len(rows)))
    words = {r["word"]: r["n"] for r in rows}
    wanted: dict = {}
    for r in documents.select("text").collect():
        for w in brute.words(r["text"]):
            wanted[w.encode()] = wanted.get(w.encode(), 0) + 1
    assert {bytes(w): n for w, n in words.items()} == wanted
