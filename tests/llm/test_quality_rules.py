from __future__ import annotations

import brute
import numpy as np

from slotledger.llm import quality_rules


def test_counts_equal_plain_python(awkward, documents):
    for docs in (awkward, documents):
        rules = quality_rules.Rules(None, None)
        found = sorted((tuple(r)[:6] + (r["base_failed"], r["kept"]) for r in quality_rules.judge(docs, rules).collect()), key=repr)
        wanted = []
        for doc, text in docs.select("doc_id", "text").collect():
            c = brute.rule_counts(text)
            failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
            wanted.append((doc, *c, failed, not failed))
        assert found == sorted(wanted, key=repr)


def test_junk_goes_and_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.fit_rules(docs, labels)
    found = quality_rules.judge(docs, rules).join(labels, "doc_id").where("NOT base_failed")
    kept = {(r["quality"], r["kept"]): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) <= 0.03 * kept[(1, True)]
    assert kept.get((0, False), 0) >= 0.8 * kept.get((0, True), 0)


def test_without_labels_only_the_base_rules_reject(awkward):
    for labels in (None, awkward.selectExpr("doc_id", "cast(null as int) AS quality")):
        rules = quality_rules.fit_rules(awkward, labels)
        rows = quality_rules.judge(awkward, rules).collect()
        assert all(r["kept"] != r["base_failed"] for r in rows)


def test_kept_documents_have_all_columns(awkward):
    rules = quality_rules.Rules(None, None)
    kept = quality_rules.keep_documents(awkward, rules)
    assert kept.columns == awkward.columns
    assert kept.count() == quality_rules.judge(awkward, rules).where("kept").count()


def test_empty_table(no_documents, labels):
    rules = quality_rules.fit_rules(no_documents, labels)
    assert quality_rules.judge(no_documents, rules).count() == 0


def test_rows_outside_the_sample_have_short_paths():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.1, (500, 3))
    far = np.array([[2.0, 2.0, 2.0]])
    forest = quality_rules.grow_forest(x, np.array([[-1.0] * 3, [2.0] * 3]))
    assert forest.path_lengths(far)[0] < np.quantile(forest.path_lengths(x), 0.01)


def test_every_labelled_row_takes_part(spark):
    """The one bad row has the largest hash of 20,101 ids: a sample of 20,000 left it out."""
    from pyspark.sql import functions as F

    n = 20_101
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    bad = ids.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).desc()).first()[0]
    clean = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda j: F.concat(F.lit("w"), j.cast("string"))))
    junk = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda j: F.concat(F.lit("#X"), j.cast("string"))))
    docs = ids.select("doc_id", F.when(F.col("doc_id") == bad, junk).otherwise(clean).alias("text"))
    labels = ids.select("doc_id", F.when(F.col("doc_id") == bad, 0).otherwise(1).alias("quality"))
    rules = quality_rules.fit_rules(docs, labels)
    assert rules.threshold is not None
    (row,) = quality_rules.judge(docs.where(F.col("doc_id") == bad), rules).collect()
    assert not row["base_failed"] and not row["kept"]


def test_texts_are_split_into_words_a_piece_at_a_time(monkeypatch):
    """A worker holds the words of about PIECE_BYTES of texts at once, with the same counts."""
    from slotledger.llm import quality_rules as q

    text = " ".join(f"w{i % 5000}" for i in range(q.PIECE_BYTES // 16)).encode()
    blobs = [text] * 6 + [b""]
    whole = q.count_texts(blobs)
    held = []
    real = q.Words
    monkeypatch.setattr(q, "Words", lambda part, *a: held.append(sum(map(len, part))) or real(part, *a))
    assert (q.count_texts(blobs) == whole).all() and (whole[:-1] == whole[0]).all()
    assert held and max(held) <= q.PIECE_BYTES
