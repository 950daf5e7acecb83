"""The anti-pattern rules as SQL functions of a session.

They are temporary SQL functions, so Spark replaces a call by its body: native
expressions in the plan, nothing to ship and no Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from slotledger import fixed_values as fv
from slotledger.functions.antipatterns import NEEDED

TABLE_FUNCTIONS = {"antipatterns"}


def _quoted(text: str) -> str:
    """A SQL string literal; backslashes and quotes are escaped."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _broken(wanted: str, silenced_by: str | None, needed: tuple[str, ...]) -> str:
    """Whether ``text`` breaks a rule; needed words are looked for first, in ASCII texts."""
    flag = f"rlike(text, {_quoted(wanted)})"
    if silenced_by is not None:
        flag += f" AND NOT rlike(text, {_quoted(silenced_by)})"
    possible = " AND ".join(f"contains(upper(text), {_quoted(word)})" for word in needed)
    return f"(length(text) <> octet_length(text) OR ({possible})) AND {flag}"


def register_functions(spark: SparkSession, jobs: str = "jobs") -> None:
    """``antipattern_codes(text)``, ``antipattern_findings(text)`` and ``antipatterns()``.

    ``antipatterns()`` has a row (job_id, statement_type, rule_no, rule, finding) for each rule
    that the text of a job of the view ``jobs`` breaks.
    """
    rules = ", ".join(
        f"CASE WHEN {_broken(wanted, silenced_by, NEEDED[code])} THEN {_quoted(code)} ELSE '' END"
        for code, wanted, silenced_by, _ in fv.ANTIPATTERN_RULES
    )
    texts = ", ".join(f"{_quoted(code)}, {_quoted(text)}" for code, _, _, text in fv.ANTIPATTERN_RULES)
    numbers = ", ".join(f"{_quoted(rule[0])}, {i}" for i, rule in enumerate(fv.ANTIPATTERN_RULES, 1))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION antipattern_codes(text STRING) RETURNS ARRAY<STRING> "
        f"RETURN CASE WHEN text IS NULL THEN array() ELSE array_remove(array({rules}), '') END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION antipattern_findings(text STRING) RETURNS ARRAY<STRING> "
        f"RETURN transform(antipattern_codes(text), code -> element_at(map({texts}), code))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION antipatterns() RETURNS TABLE "
        "(job_id STRING, statement_type STRING, rule_no INT, rule STRING, finding STRING) RETURN "
        f"SELECT job_id, statement_type, element_at(map({numbers}), rule), rule, "
        f"element_at(map({texts}), rule) FROM "
        f"(SELECT job_id, statement_type, antipattern_codes(query) AS codes FROM {jobs}) "
        "LATERAL VIEW explode(codes) AS rule"
    )
