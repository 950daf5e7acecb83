"""Ad-hoc SQL over the views of a warehouse: queries only, and only over those views.

A text is parsed before it runs, and its logical plan says what it would do. Spark runs a
command (DDL, writes, settings, SHOW) while it makes the DataFrame, so nothing but the
plan can tell in time. Operators are let through by name, so commands, scripts, external
programs and whatever a later Spark adds are refused; so are functions that call into
the JVM, and relations other than the warehouse's views, the text's own CTEs and table
functions. Nothing is run for a refused text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from slotledger.functions.sql_functions import TABLE_FUNCTIONS, register_functions
from slotledger.sources.warehouse import Warehouse

_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"
#: Logical operators of queries, as Spark's parser names them.
_OPERATORS = {
    "Aggregate", "AsOfJoin", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit",
    "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot", "Project",
    "RebalancePartitions", "Repartition", "RepartitionByExpression", "Sample", "Sort", "SubqueryAlias", "Union",
    "Unpivot", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedPivot",
    "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases",
    "UnresolvedTableValuedFunction", "UnresolvedWith", "Window", "WithWindowDefinition",
}
_JVM_CALLS = {"reflect", "java_method", "try_reflect"}
#: Table functions that only make rows of their arguments.
_ROW_FUNCTIONS = {
    "explode", "explode_outer", "inline", "inline_outer", "posexplode", "posexplode_outer", "stack",
    "json_tuple", "range", "variant_explode", "variant_explode_outer",
}


class QueryRefused(ValueError):
    """The text is no query over the warehouse's views."""


class _Plan:
    """The parsed plan of one text."""

    def __init__(self, spark: SparkSession, text: str):
        self.jvm = spark.sparkContext._jvm
        self.root = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)

    def is_a(self, node: Any, name: str) -> bool:
        return self.jvm.java.lang.Class.forName(name).isInstance(node)

    def nodes(self) -> Iterator[Any]:
        """Every plan node and expression, those inside subqueries and CTEs included."""
        pending = [self.root]
        while pending:
            node = pending.pop()
            yield node
            for children in (node.children(), node.innerChildren()):
                pending.extend(children.apply(i) for i in range(children.size()))
            if self.is_a(node, f"{_LOGICAL}.LogicalPlan"):
                held = node.expressions()
                pending.extend(held.apply(i) for i in range(held.size()))
            elif self.is_a(node, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
                pending.append(node.plan())


def _names(parts: Any) -> list[str]:
    return [parts.apply(i) for i in range(parts.size())]


def check_query(spark: SparkSession, query: str, views: set[str]) -> None:
    """Raise ``QueryRefused`` unless ``query`` only reads ``views``; nothing is run."""
    plan = _Plan(spark, query)
    known = {view.lower() for view in views}
    relations: list[list[str]] = []
    for node in plan.nodes():
        kind = node.getClass().getSimpleName()
        if plan.is_a(node, f"{_LOGICAL}.LogicalPlan") and kind not in _OPERATORS:
            raise QueryRefused(f"only queries over the warehouse's views are run here, this has {kind}")
        if kind == "UnresolvedRelation":
            relations.append(_names(node.multipartIdentifier()))
        elif kind == "ExpressionWithUnresolvedIdentifier":
            raise QueryRefused("IDENTIFIER() can name anything; write the name out")
        elif kind == "UnresolvedWith":
            ctes = node.cteRelations()
            known |= {ctes.apply(i)._1().lower() for i in range(ctes.size())}
        elif kind == "UnresolvedTableValuedFunction":
            name = ".".join(_names(node.name()))
            if name.lower() not in _ROW_FUNCTIONS | TABLE_FUNCTIONS:
                raise QueryRefused(f"table function {name!r} is not available")
        elif kind == "UnresolvedFunction" and _names(node.nameParts())[-1].lower() in _JVM_CALLS:
            raise QueryRefused("functions that call into the JVM are not available")
    for name in relations:
        if len(name) > 1 or name[0].lower() not in known:
            raise QueryRefused(f"{'.'.join(name)!r} is no view of this warehouse")


def adhoc_sql(
    wh: Warehouse, query: str, params: dict[str, Any] | None = None, prefix: str = ""
) -> DataFrame:
    """Run a query over the warehouse's views, with ``:name`` parameters.

    ``prefix`` goes before the views' names, so that a session's own views of the
    same name stay as they are; a clash with one of those is an error. The text rules are at
    hand as ``antipattern_codes(sql)``, ``antipattern_findings(sql)`` and the table
    function ``antipatterns()``. Anything but a query over the views is ``QueryRefused``.
    """
    check_query(wh.spark, query, {f"{prefix}{name}" for name in wh.names})
    wh.register(prefix)
    if "jobs" in wh.names:
        register_functions(wh.spark, f"{prefix}jobs")
    return wh.spark.sql(query, args=params or {})
