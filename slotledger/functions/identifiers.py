"""Table identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALLOWED = re.compile(r"[a-zA-Z0-9_.-]+\Z")


def parse_table_name(name: str) -> tuple[str | None, str]:
    """``[project.]dataset.table`` -> (dataset or None, table)."""
    if not name:
        raise ValueError("table name is empty")
    if not _ALLOWED.match(name):
        raise ValueError(f"not a table name: {name!r}")
    *prefix, table = name.split(".")
    return (prefix[-1] if prefix else None), table


def dataset_part(name: Column) -> Column:
    """Dataset of a ``[project.]dataset.table`` column, null for a bare table."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def table_part(name: Column) -> Column:
    """Table of a ``[project.]dataset.table`` column."""
    return F.element_at(F.split(name, r"\."), -1)
