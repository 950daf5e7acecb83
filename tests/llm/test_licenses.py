from __future__ import annotations

import compare

from slotledger.llm import licenses, queries


def _scan(spark, *texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, m string")
    rows = licenses.scan_licenses(docs).orderBy("doc_id").collect()
    return [(r["n_matches"], r["licenses"], r["best_dice"]) for r in rows]


def test_equals_sql_without_pruning(spark, sf):
    sql = queries.oracle_sql()["op7_license_scan"]
    names, rows = compare.spark_rows(queries.op7_license_scan(spark, sf))
    assert (names, rows) == compare.sql_rows(compare.connect(sf), sql)
    assert any(r[names.index("n_matches")] for r in rows)


def test_notices_and_near_notices(spark):
    mit = licenses.TEMPLATES[3][1]
    found = _scan(
        spark, None, "", "word", "Released under the MIT License.", "foo\nreleased UNDER the mit - license!\nbar",
        "a permission to be free\n" + mit.replace("limitation", "limits") + "\nrest", "under the license of the sea",
        "Licensed under CC BY-NC 4.0.\n\nLicensed under the Apache License, Version 2.0.",
    )
    assert [f[1] for f in found] == ["", "", "", "MIT", "MIT", "MIT", "", "Apache-2.0,CC-BY-NC-4.0"]
    assert found[0] == (0, "", None) and found[3] == (1, "MIT", 1.0) and 0.8 <= found[5][2] < 1


def test_every_template_matches_itself_and_holds_a_cue(spark):
    cues = set(licenses.cue_words())
    for (_, _, dice), (_, text) in zip(_scan(spark, *[t for _, t in licenses.TEMPLATES]), licenses.TEMPLATES, strict=True):
        assert dice == 1.0 and cues & set(licenses.plain_words(text))


def test_awkward_and_empty_tables(awkward, no_documents):
    found = licenses.scan_licenses(awkward)
    assert found.count() == awkward.count() and found.where("n_matches > 0").count() == 0
    assert licenses.scan_licenses(no_documents).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_kind_of_notice_in_the_documents_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kinds = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "All rights reserved.": "Proprietary",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    wanted = {
        r["doc_id"]: {name for line, name in kinds.items() if line in r["text"].split("\n")}
        for r in docs.where("text IS NOT NULL").collect()
    }
    assert {name for names in wanted.values() for name in names} == set(kinds.values())
    found = {r["doc_id"]: set(r["licenses"].split(",")) for r in licenses.scan_licenses(docs).collect()}
    assert all(names <= found[i] for i, names in wanted.items())


def test_notices_within_lines_and_across_line_ends(spark):
    mit, apache = licenses.TEMPLATES[3][1], licenses.TEMPLATES[6][1]
    words, other = mit.split(), " ".join(f"f{i}" for i in range(80))
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    found = _scan(
        spark, "Copyright 2020 Foo. Licensed under the MIT License.",
        "some words before it, licensed under the Apache License, version 2.0, and then some more after it",
        f"{other}\nsecond line {wrapped} and more\nlast line",
        "a paragraph that is licensed under the\nGNU General Public License, version 2. It goes on\nfor long",
        "(c) 2020 Foo. All rights reserved. Made by many.", f"{other} {apache} z",
        "All rights reserved.\nWe said: all rights reserved, and under CC BY 4.0, licensed under CC BY-NC 4.0 too.",
        "the license of this software is free of terms", "all the rights are reserved in part",
    )
    assert [(n, names) for n, names, _ in found] == [
        (1, "MIT"), (1, "Apache-2.0"), (1, "MIT"), (1, "GPL-2.0"), (1, "Proprietary"), (1, "Apache-2.0"),
        (3, "CC-BY-4.0,CC-BY-NC-4.0,Proprietary"), (0, ""), (0, ""),
    ]
    assert all(dice == 1.0 for n, _, dice in found if n)
