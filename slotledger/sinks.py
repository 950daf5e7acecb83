"""Writing results out.

A bundle is a set of reports written together. Each run writes its reports to a folder of
its own and becomes visible through one row a report in the bundle's log, a table with
a partition a run. The log is written last, so a run that fails shows nothing; a run that
is repeated under its id replaces its own partition, so nothing is logged twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from slotledger.functions.clock import resolve

LOG = "run_id string, run_at timestamp, key string, params string, rows bigint, path string"


def write_tables_by_title(
    latest: DataFrame, root: str, mode: str = "overwrite"
) -> None:
    """Write ``latest_tables`` as JSON records in ``session_id=/title=`` folders."""
    records = latest.select("session_id", "title", F.explode("records").alias("value"))
    records.write.mode(mode).partitionBy("session_id", "title").text(root)


def write_bundle(
    reports: Mapping[str, DataFrame],
    root: str,
    run_id: str,
    params: Mapping[str, Mapping[str, Any]] | None = None,
    run_at: datetime | None = None,
) -> None:
    """Write reports as Parquet tables and log them as run ``run_id``, all or none.

    Rows are counted as they are written; ``params`` has the arguments of a report by its key.
    """
    if not reports:
        raise ValueError("a bundle needs a report")
    attempt = f"{root.rstrip('/')}/runs/{uuid.uuid4().hex}"
    lines = []
    for key, report in reports.items():
        seen = Observation()
        path = f"{attempt}/{key}"
        report.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        told = json.dumps(dict((params or {}).get(key, {})), sort_keys=True, default=str)
        lines.append((run_id, resolve(run_at), key, told, seen.get["rows"], path))
    spark = next(iter(reports.values())).sparkSession
    log = spark.createDataFrame(lines, LOG).coalesce(1)
    (
        log.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(f"{root.rstrip('/')}/log")
    )


def bundle_log(spark: SparkSession, root: str) -> DataFrame:
    """``run_id, run_at, key, params, rows, path`` of every report of every finished run."""
    try:
        return spark.read.schema(LOG).parquet(f"{root.rstrip('/')}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def read_bundle(spark: SparkSession, root: str, key: str, run_id: str | None = None) -> DataFrame:
    """Report ``key`` of a run; of the latest run that has it when none is given."""
    runs = bundle_log(spark, root).where(F.col("key") == key)
    if run_id is not None:
        runs = runs.where(F.col("run_id") == run_id)
    latest = runs.orderBy(F.desc("run_at"), F.desc("run_id")).first()
    if latest is None:
        raise KeyError(f"no finished run has a report {key!r}")
    return spark.read.parquet(latest["path"])
