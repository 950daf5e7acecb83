from __future__ import annotations

import datetime as dt
import random

import pytest

from slotledger import fixed_values as fv
from slotledger.operators.antipatterns import antipattern_queries, detect_antipatterns

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)

CASES = [
    ("select *\n from t", {"SELECT_STAR"}),
    ("SELECT\u00a0*\u2003FROM t", {"SELECT_STAR"}),
    ("select a.* from t", set()),
    ("select a from t order by rand() limit 5", {"ORDER_BY_RAND"}),
    ("select a from t order by a", {"ORDER_WITHOUT_LIMIT"}),
    ("select a from t order by a limit @n", set()),
    ("select a from t order by a limit all", {"ORDER_WITHOUT_LIMIT"}),
    ("select row_number() over (order by a) from (select a from t limit 3)", set()),
    ("select regexp_contains(a, 'x')", {"REGEXP"}),
    ("select a from t where a like '%x'", {"LEADING_WILDCARD"}),
    ("select a from t where a like 'x%'", set()),
    ("select a from t cross\njoin u", {"CROSS_JOIN"}),
    ("select a from `p.d.t` , u", {"COMMA_JOIN"}),
    ("select a from `my-p.d.t`, u", set()),
    ("insert into t values (1)", {"SINGLE_ROW_INSERT"}),
    ("insert into t\nvalues (1)", set()),
    ("select a from t where b = 1\nand cast( c as string ) = 'x'", {"STRING_CAST_FILTER"}),
    ("select cast(c as string) from t", set()),
    ("select a from t where b in\n(\nselect c from u)", {"IN_SUBQUERY"}),
    ("select a from t union select b from u", {"UNION_DISTINCT"}),
    ("select a from t union all select b from u", set()),
    ("select a from t union  all select b from u", {"UNION_DISTINCT"}),
    ("select a from t union\nall select b from u", set()),
    ("", set()),
]


def test_rules(spark):
    texts = spark.createDataFrame([(i, sql) for i, (sql, _) in enumerate(CASES)], "i int, query string")
    rows = {r.i: r for r in detect_antipatterns(texts).collect()}
    by_code = {rule[0]: rule[3] for rule in fv.ANTIPATTERN_RULES}
    for i, (sql, wanted) in enumerate(CASES):
        assert set(rows[i].rule_codes) == wanted, sql
        assert rows[i].findings == [by_code[code] for code in rows[i].rule_codes]


def test_findings_keep_rule_order(spark):
    sql = "select * from t, u cross join v union select 1 order by rand()"
    row = detect_antipatterns(spark.createDataFrame([(sql,)], "query string")).first()
    order = [rule[0] for rule in fv.ANTIPATTERN_RULES]
    assert row.rule_codes == sorted(row.rule_codes, key=order.index)
    assert len(row.rule_codes) == 6


def test_heaviest_run_of_each_text(frame):
    def job(job_id, query, ms, statement="SELECT"):
        return {"job_id": job_id, "creation_time": AS_OF - dt.timedelta(days=1), "query": query,
                "statement_type": statement, "total_slot_ms": ms, "user_email": job_id,
                "total_bytes_processed": 2**30}

    jobs = frame("jobs", [
        job("b", "select a from t", 7_200_000), job("a", "select a from t", 7_200_000),
        job("c", "select * from t", 3_600_000), job("d", "select * from t", 1),
        job("e", "insert into t values (1)", 9_000_000, "INSERT"), job("f", "select b", None)])
    rows = antipattern_queries(jobs, AS_OF).collect()
    assert [(r.job_id, r.slot_hours) for r in rows] == [("a", 2.0), ("c", 1.0), ("f", None)]
    assert rows[0].detected_antipatterns == [fv.NO_ANTIPATTERN]
    assert rows[1].detected_antipatterns[0].startswith("SELECT *")
    assert antipattern_queries(jobs, AS_OF, k=1).count() == 1
    later = AS_OF + dt.timedelta(days=90)
    assert antipattern_queries(jobs, later).count() == 0
    assert antipattern_queries(jobs, later, days=None, k=None).count() == 3


FRAGMENTS = (
    "select|SELECT|\u017felect|*|from|FROM|t|,|`a.b`|order|by|rand()|limit|@n|5|regexp_contains|"
    "like|l\u0131ke|L\u0130KE|li\u212ae|'%x'|'x%'|cross|join|JO\u0130N|insert|into|values|(|)|where|cast(|cast (|"
    "c|as|string)|\u017ftring|STRING|in|union|UNION|all|\n|\u00a0|\u00e9|"
    "order by rand()|insert into t values (|where cast( c as string )|JOIN u ON CAST(b AS STRING)"
).split("|")


def test_shortcuts_never_change_a_rule(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    texts = []
    for _ in range(6000):
        picked = rnd.choices(FRAGMENTS, k=rnd.randrange(1, 12))
        texts.append((rnd.choice([" ", "", "  ", "\n"]).join(picked),))
    df = spark.createDataFrame(texts, "query string")
    sql = F.col("query")
    plain = [
        F.when(sql.rlike(wanted) & (F.lit(True) if other is None else ~sql.rlike(other)), code)
        for code, wanted, other, _ in fv.ANTIPATTERN_RULES
    ]
    found = detect_antipatterns(df).select(
        "query", "rule_codes", F.array_compact(F.array(*plain)).alias("plain")
    )
    assert found.where(F.col("rule_codes") != F.col("plain")).collect() == []
    fired = {r.c for r in found.select(F.explode("plain").alias("c")).distinct().collect()}
    assert fired == {rule[0] for rule in fv.ANTIPATTERN_RULES}


@pytest.mark.parametrize("code", [rule[0] for rule in fv.ANTIPATTERN_RULES])
def test_every_rule_fires_on_the_derived_jobs(warehouse, code):
    from pyspark.sql import functions as F

    found = detect_antipatterns(warehouse.jobs)
    assert found.where(F.array_contains("rule_codes", code)).limit(1).count() == 1
