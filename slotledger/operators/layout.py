"""Table layout reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotledger import fixed_values as fv
from slotledger.functions.clock import last_days
from slotledger.functions.measures import gib
from slotledger.functions.topk import top
from slotledger.operators.cost import table_references, unpartitioned_tables

#: Tables that may be broadcast by hint (three names and numbers a row).
SMALL = 10_000


def partition_key_candidates(
    jobs: DataFrame,
    table_storage: DataFrame,
    tables: DataFrame,
    as_of: datetime | None = None,
    days: int = 30,
    k_tables: int | None = 3,
    k_queries: int | None = 3,
    match_dataset: bool = False,
) -> DataFrame:
    """Heaviest SELECTs on each of the largest unpartitioned tables; all of either when None.

    References are matched by table name; ``match_dataset`` also compares the
    dataset. The ranking keeps ``k_queries`` rows per table within each task
    before the shuffle, so a table that most jobs read does not pile up.
    """
    large = top(
        unpartitioned_tables(table_storage, tables, fv.LARGE_TABLE_BYTES),
        k_tables,
        F.desc("total_logical_bytes"),
        F.col("table_schema"),
        F.col("table_name"),
    )
    selects = last_days(jobs, "creation_time", as_of, days).where(
        F.col("statement_type") == "SELECT"
    )
    uses = table_references(selects, "job_id", "query", "total_slot_ms")
    on = F.col("table_id") == F.col("table_name")
    if match_dataset:
        on = on & (F.col("dataset_id") == F.col("table_schema"))
    if k_tables is not None and k_tables <= SMALL:
        large = F.broadcast(large)
    heavy = uses.join(large, on)
    rank = F.row_number().over(
        Window.partitionBy("table_name").orderBy(
            F.desc("total_slot_ms"), F.col("job_id"), F.col("dataset_id"), F.col("table_schema")
        )
    )
    if k_queries is not None:
        heavy = heavy.withColumn("_rank", rank).where(F.col("_rank") <= k_queries)
    return heavy.select("table_name", gib(F.col("total_logical_bytes")).alias("size_gb"), "query")
