"""Security and governance reports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger import fixed_values as fv
from slotledger.functions.clock import between, resolve
from slotledger.functions.identifiers import parse_table_name
from slotledger.functions.topk import newest_distinct


def table_permissions(object_privileges: DataFrame, table_name: str | None = None) -> DataFrame:
    """Who may SELECT from a table, ``[dataset.]table``; from any table when not given."""
    grants = object_privileges.where(
        (F.col("object_type") == "TABLE") & (F.col("privilege_type") == "SELECT")
    )
    if table_name is not None:
        dataset, table = parse_table_name(table_name)
        grants = grants.where(F.col("object_name") == table)
        if dataset is not None:
            grants = grants.where(F.col("object_schema") == dataset)
    return grants.select("grantee", "privilege_type", "object_schema", "object_name")


def public_datasets(datasets: DataFrame) -> DataFrame:
    """Access entries open to everyone."""
    return (
        datasets.select("dataset_id", F.inline("access_entries"))
        .where(F.col("special_group").isin(*fv.PUBLIC_GROUPS))
        .select(
            F.col("dataset_id").alias("object_name"),
            F.col("special_group").alias("grantee"),
            "role",
            F.lit(fv.PUBLIC_NOTE).alias("note"),
        )
    )


def recent_table_users(
    jobs: DataFrame,
    table_name: str,
    as_of: datetime | None = None,
    days: int = 30,
    k: int | None = 50,
) -> DataFrame:
    """Latest distinct uses of one table, both ends of the window included; all when k is None.

    Testing the reference array in place gives the rows an explode and a
    ``distinct`` would, without multiplying them first, and reads only the
    name leaves of the array.
    """
    dataset, table = parse_table_name(table_name)
    end = resolve(as_of)
    tables = F.col("referenced_tables.table_id")
    used = F.array_contains(tables, table)
    if dataset is not None:
        datasets = F.col("referenced_tables.dataset_id")
        wanted = F.struct(F.lit(dataset).alias("dataset_id"), F.lit(table).alias("table_id"))
        pairs = F.arrays_zip(datasets.alias("dataset_id"), tables.alias("table_id"))
        used = F.array_contains(pairs, wanted)
    uses = (
        between(jobs, "creation_time", end - timedelta(days=days), end, inclusive=True)
        .where(used)
        .select("user_email", "creation_time", "query")
    )
    return newest_distinct(uses, "creation_time", k, F.col("user_email"), F.col("query"))
