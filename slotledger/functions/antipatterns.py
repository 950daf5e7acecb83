"""SQL anti-pattern rules as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotledger import fixed_values as fv

RULE_CODES = tuple(rule[0] for rule in fv.ANTIPATTERN_RULES)

# Upper-case text that every match of a rule contains. Looking for it is far
# cheaper than the pattern, and most texts break few rules.
NEEDED = {
    "SELECT_STAR": ("*", "SELECT", "FROM"),
    "ORDER_BY_RAND": ("RAND()", "ORDER"),
    "ORDER_WITHOUT_LIMIT": ("ORDER", "BY"),
    "REGEXP": ("REGEXP_CONTAINS",),
    "LEADING_WILDCARD": ("%", "LIKE"),
    "CROSS_JOIN": ("CROSS", "JOIN"),
    "COMMA_JOIN": (",", "FROM"),
    "SINGLE_ROW_INSERT": ("INSERT", "VALUES", "("),
    "STRING_CAST_FILTER": ("CAST(", "STRING"),
    "IN_SUBQUERY": ("(", "SELECT"),
    "UNION_DISTINCT": ("UNION",),
}


def rule_flags(sql: Column) -> dict[str, Column]:
    """One boolean column per rule, in rule order.

    The shortcut holds for ASCII text only: beyond it, letters exist that match
    an ASCII letter without sharing its upper case.
    """
    beyond_ascii = F.length(sql) != F.octet_length(sql)
    upper = F.upper(sql)
    flags = {}
    for code, wanted, silenced_by, _ in fv.ANTIPATTERN_RULES:
        possible = reduce(Column.__and__, [upper.contains(text) for text in NEEDED[code]])
        flag = (beyond_ascii | possible) & sql.rlike(wanted)
        if silenced_by is not None:
            flag = flag & ~sql.rlike(silenced_by)
        flags[code] = flag
    return flags


def finding_codes(sql: Column) -> Column:
    """Array of the codes of the rules that ``sql`` breaks, in rule order."""
    flags = rule_flags(sql)
    # Unlike array_compact, array_remove stays within generated code.
    return F.array_remove(
        F.array(*[F.when(flags[code], code).otherwise("") for code in RULE_CODES]), ""
    )


def finding_texts(codes: Column) -> Column:
    """Array of the finding texts of an array of rule codes."""
    texts = F.create_map(
        *[F.lit(value) for code, _, _, text in fv.ANTIPATTERN_RULES for value in (code, text)]
    )
    return F.transform(codes, lambda code: texts[code])
