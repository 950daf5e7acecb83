"""Tables that cut a lineage, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from slotledger.sources.folders import new_path, shared_folder

__all__ = ["new_path", "shared_folder", "written"]


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, computed once and read back from Parquet.

    A lost executor costs a repeated read, not a repeated computation.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
