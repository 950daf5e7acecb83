"""Ad-hoc SQL runs queries over the views and nothing else."""

from __future__ import annotations

import pytest
from pyspark.errors import ParseException

from slotledger.functions.antipatterns import RULE_CODES
from slotledger.operators.antipatterns import detect_antipatterns
from slotledger.plans.adhoc import QueryRefused, adhoc_sql

COMMANDS = [
    "DROP TABLE own_table",
    "DROP VIEW jobs",
    "CREATE TABLE made AS SELECT * FROM jobs",
    "CREATE TABLE made (a INT) USING parquet",
    "CREATE OR REPLACE TEMPORARY VIEW jobs AS SELECT 1 AS a",
    "INSERT INTO own_table SELECT 1",
    "INSERT OVERWRITE own_table VALUES (1)",
    "FROM jobs INSERT INTO own_table SELECT 1 INSERT INTO own_table SELECT 2",
    "WITH x AS (SELECT 1 AS a) INSERT INTO own_table SELECT a FROM x",
    "INSERT OVERWRITE DIRECTORY '/tmp/slotledger-never' USING parquet SELECT 1 AS a",
    "DELETE FROM own_table",
    "UPDATE own_table SET a = 1",
    "MERGE INTO own_table t USING jobs s ON false WHEN NOT MATCHED THEN INSERT *",
    "TRUNCATE TABLE own_table",
    "ALTER TABLE own_table RENAME TO other",
    "SET spark.sql.ansi.enabled=false",
    "RESET",
    "USE default",
    "SHOW TABLES",
    "DESCRIBE jobs",
    "EXPLAIN SELECT 1",
    "CACHE TABLE jobs",
    "ADD JAR 'x.jar'",
    "CREATE TEMPORARY FUNCTION f() RETURNS INT RETURN 1",
    "REFRESH TABLE own_table",
    "ANALYZE TABLE own_table COMPUTE STATISTICS",
    "BEGIN SELECT 1; DROP TABLE own_table; END",
    "DECLARE VARIABLE v INT",
    "EXECUTE IMMEDIATE 'DROP TABLE own_table'",
]
NOT_OURS = [
    "SELECT * FROM own_table",
    "SELECT * FROM default.own_table",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
    "SELECT * FROM jobs WHERE job_id IN (SELECT a FROM own_table)",
    "SELECT (SELECT max(a) FROM own_table) AS m",
    "SELECT 1 WHERE EXISTS (SELECT 1 FROM own_table)",
    "WITH x AS (SELECT * FROM own_table) SELECT * FROM x",
    "SELECT * FROM jobs JOIN own_table ON true",
    "SELECT * FROM jobs UNION ALL SELECT * FROM own_table",
    "SELECT * FROM jobs, LATERAL (SELECT * FROM own_table)",
    "TABLE own_table",
    "SELECT * FROM IDENTIFIER('own_table')",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT TRANSFORM(job_id) USING 'cat' AS (a) FROM jobs",
    "SELECT * FROM python_worker_logs()",
]


@pytest.fixture(scope="module")
def own_table(spark):
    spark.sql("DROP TABLE IF EXISTS own_table")
    spark.createDataFrame([(7,)], "a int").write.saveAsTable("own_table")
    yield
    spark.sql("DROP TABLE own_table")


@pytest.mark.parametrize("text", [*COMMANDS, *NOT_OURS])
def test_everything_else_is_refused_and_nothing_runs(spark, warehouse, own_table, text):
    tables = {t.name for t in spark.catalog.listTables()}
    with pytest.raises((QueryRefused, ParseException)):
        adhoc_sql(warehouse, text)
    assert {t.name for t in spark.catalog.listTables()} == tables
    assert [r.a for r in spark.table("own_table").collect()] == [7]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


@pytest.mark.parametrize("text", [
    "SELECT count(*) AS n FROM jobs",
    "WITH x AS (SELECT job_id FROM JOBS), y AS (SELECT * FROM x) SELECT count(*) AS n FROM y",
    "SELECT count(*) AS n FROM jobs, LATERAL explode(referenced_tables) AS t(r)",
    "SELECT * FROM range(3)",
    "SELECT * FROM VALUES (1), (2)",
    "SELECT job_id FROM jobs WHERE job_id = (SELECT max(job_id) FROM jobs_timeline)",
    "FROM jobs |> WHERE job_type = 'LOAD' |> AGGREGATE count(*) AS n",
    "SELECT job_id FROM jobs TABLESAMPLE (10 ROWS)",
    "SELECT /*+ REPARTITION(3) */ DISTINCT job_type FROM jobs ORDER BY 1 LIMIT 5 OFFSET 1",
    "SELECT job_type, count(*) AS n FROM jobs GROUP BY ROLLUP (job_type) HAVING n > 0",
    "SELECT job_id, row_number() OVER w AS r FROM jobs WINDOW w AS (ORDER BY job_id) LIMIT 1",
    "SELECT * FROM (SELECT job_type, total_slot_ms FROM jobs) PIVOT (sum(total_slot_ms) FOR job_type IN ('QUERY'))",
    "SELECT * FROM (SELECT 1 AS a, 2 AS b) UNPIVOT (v FOR k IN (a, b))",
    "SELECT job_id FROM jobs EXCEPT SELECT job_id FROM jobs WHERE job_type = 'LOAD'",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT * FROM r",
    "SELECT j.job_id, s.name FROM jobs AS j LATERAL VIEW inline(job_stages) s LIMIT 3",
    "SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM reservations)) AS n FROM jobs",
])
def test_queries_run(warehouse, text):
    assert adhoc_sql(warehouse, text).collect()


def test_prefixed_views(warehouse):
    assert adhoc_sql(warehouse, "SELECT count(*) AS n FROM p_jobs", prefix="p_").first()["n"] > 0
    with pytest.raises(QueryRefused):
        adhoc_sql(warehouse, "SELECT * FROM jobs", prefix="p_")


def test_a_second_sessions_views_stay(spark, warehouse):
    from slotledger.sources.driver_tables import driver_warehouse

    adhoc_sql(warehouse, "SELECT 1 AS a")
    other = spark.newSession()
    other.range(5).createOrReplaceTempView("jobs")
    with pytest.raises(ValueError, match="of its own"):
        adhoc_sql(driver_warehouse(other, "/root/testdata/sf0.001"), "SELECT 1 AS a")
    assert other.table("jobs").count() == 5


def test_rules_in_sql_are_the_rules(spark, warehouse):
    texts = [r.query for r in warehouse.jobs.select("query").distinct().collect()]
    texts += [None, "", "select *\nfrom a", "ſELECT * FROM x", "SELECT a'b\\ FROM t ORDER BY a", "x LIKE '%y'"]
    df = spark.createDataFrame([(t,) for t in texts], "query string")
    df.createOrReplaceTempView("rule_texts")
    wanted = {r.query: (r.rule_codes, r.findings) for r in detect_antipatterns(df).collect()}
    adhoc_sql(warehouse, "SELECT 1 AS a")
    found = spark.sql("SELECT query, antipattern_codes(query) AS c, antipattern_findings(query) AS f FROM rule_texts")
    for r in found.collect():
        assert (r.c, r.f) == (wanted[r.query] if r.query is not None else ([], [])), r.query
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    rows = adhoc_sql(warehouse, "SELECT DISTINCT rule, rule_no FROM antipatterns()").collect()
    assert rows and all(RULE_CODES[r.rule_no - 1] == r.rule for r in rows)
