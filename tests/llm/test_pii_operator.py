from __future__ import annotations

import brute
import pytest
from pyspark.sql import functions as F

from slotledger.llm import pii

TRAPS = [
    "x a@b.c+d@e.f.g +1 (713) 555-8702 y 4272683025356771 é ü 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004",
    "+1 2" * 50, "1" * 30_000, "a." * 20_000 + "@x.y", "1.2." * 5000, "a@b" * 2000 + ".c", "😀 a@b.co 😀 1.2.3.4",
    "card 4591 4674 0170 4471x 4591-4674-0170-4472", "tel +1 (713) 555-8702 +1 (713) 555-8703", "a@b.c@d.e",
]


@pytest.fixture(scope="module")
def rows(spark, awkward, documents):
    traps = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TRAPS)], "doc_id long, text string")
    more = documents.select(F.col("doc_id") + 2000, "text")
    return awkward.select("doc_id", "text").union(traps).union(more)


def test_base_spans_equal_plain_regexes(rows):
    found = pii.digests(pii.find_pii(rows)).collect()
    texts = {}
    for doc, text in rows.collect():
        texts.setdefault(doc, text)
    assert len(found) == rows.count()
    for row in found:
        wanted = brute.spans(texts[row["doc_id"]])
        text = ",".join(f"{k}:{a}:{e}" for a, e, k in wanted)
        assert row["base_sha256"] == brute.sha(text)
        kinds = [k for _, _, k in wanted]
        assert [row[f"n_{k}"] for k in brute.KINDS] == [kinds.count(k) for k in brute.KINDS]
        assert not text or set(text.split(",")) <= set(row["spans"].split(","))


def test_clean_text_has_no_spans(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox, version 2.0 of 2024")], "doc_id long, text string")
    assert pii.digests(pii.find_pii(docs)).first()["spans"] == ""


def test_look_of_confirmed_spans_carries_over(spark):
    rows = [(i, f"please call +1 ({200 + i % 700}) 555-{1000 + i} today, order {1000 + i} of {i}") for i in range(800)]
    rows.append((9000, "please call 1 (713) 555-8702 today"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find_pii(docs)).collect()}
    assert found[9000] == "phone:12:28"
    assert all(found[i].count(":") == 2 for i in range(800))


def test_boosting_separates_what_a_feature_tells():
    levels = {name: 0 for name in pii.FEATURES}
    rows = [levels | {"digits": d, "groups": g, "n": 50, "p": 50 * (d >= 4)} for d in range(8) for g in range(6)]
    scorer = pii.Scorer(*({0: x} for x in pii.boost(rows)))
    scores = [scorer.value(0, r) for r in rows]
    assert min(s for s, r in zip(scores, rows, strict=True) if r["p"]) > 1
    assert max(s for s, r in zip(scores, rows, strict=True) if not r["p"]) < -1


def test_redaction_keeps_columns_and_rows(awkward, spark):
    docs = awkward.unionByName(
        spark.createDataFrame([(77, "mail a.b@c.de or 10.0.0.1!")], "doc_id long, text string"), allowMissingColumns=True
    )
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 77").first()["text"] == "mail [EMAIL] or [IP]!"
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == before[r["doc_id"]] for r in out.where("doc_id <> 77").collect())


def test_empty_table(no_documents):
    assert pii.digests(pii.find_pii(no_documents)).count() == 0
    assert pii.redact(no_documents).count() == 0


def test_no_python_on_the_path(documents):
    plan = pii.spans_table(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
