"""Environment scan: twelve checks as one plan."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger import fixed_values as fv
from slotledger.functions.clock import last_days, resolve, seconds_between, utc_date
from slotledger.functions.measures import decimal_text, slot_hours
from slotledger.operators import cost, governance, performance, recommendations
from slotledger.sources.warehouse import Warehouse


def _finding(seq: int, area: str, metric: str, value: Column, text: str) -> Column:
    return F.struct(
        F.lit(seq).alias("seq"),
        F.lit(area).alias("area"),
        F.lit(metric).alias("metric"),
        value.alias("value"),
        F.format_string(text, value).alias("finding"),
    )


def _rows(one_row: DataFrame, *findings: Column) -> DataFrame:
    """Findings of a one-row frame; those without a value are dropped."""
    return one_row.select(F.inline(F.array(*findings))).where(F.col("value").isNotNull())


def _number(n: Column, limit: int | None = None) -> Column:
    """A count as text, at most ``limit``; null for none."""
    shown = n if limit is None else F.least(n, F.lit(limit))
    return F.when(n > 0, shown.cast("string"))


def recommendation_findings(wh: Warehouse, limits: Mapping[str, int]) -> DataFrame:
    """Active access and partitioning recommendations, from one pass."""
    wanted = {
        "iam_recommendations": (7, "security", recommendations.from_iam(), fv.FINDING_IAM),
        "partitioning": (12, "performance", recommendations.from_partitioning(), fv.FINDING_PARTITIONING),
    }
    active = recommendations.active(wh.recommendations, F.lit(True))
    counts = active.agg(*[F.count_if(w[2]).alias(metric) for metric, w in wanted.items()])
    return _rows(
        counts,
        *[
            _finding(seq, area, metric, _number(F.col(metric), limits.get(metric)), text)
            for metric, (seq, area, _, text) in wanted.items()
        ],
    )


def storage_findings(
    wh: Warehouse, as_of: datetime | None, limits: Mapping[str, int]
) -> DataFrame:
    """Time travel, unused, logically billed and unpartitioned tables, from one read of the storage.

    Tables collapse to a row a name and size with the counts of their rows; what each check
    joins them with is one row a key, so the joins keep that number of rows and one
    aggregate reads all four counts.
    """
    c = F.col
    key = ["table_schema", "table_name"]
    tables = wh.table_storage.groupBy(*key, "total_logical_bytes").agg(
        F.count_if(cost.has_time_travel()).alias("travelling"),
        F.count_if(cost.is_stored()).alias("stored"),
        F.count(F.lit(1)).alias("rows"),
    )
    used = cost.used_tables(wh.jobs, as_of, fv.SCAN_UNUSED_DAYS).withColumn("used", F.lit(True))
    flat = cost.flat_tables(wh.tables).groupBy(*key).agg(F.count(F.lit(1)).alias("flat"))
    logical = F.count_if(cost.is_billed_logically()).alias("logical")
    models = cost.billing_models(wh.schemata_options).groupBy("table_schema").agg(logical)
    joined = tables.join(used, key, "left").join(flat, key, "left").join(models, "table_schema", "left")
    bytes_ = c("total_logical_bytes")
    counts = joined.agg(
        F.sum("travelling").alias("time_travel"),
        F.count_if((bytes_ > 0) & c("used").isNull()).alias("unused_tables"),
        # A dataset without the option counts as one that is billed logically.
        F.sum(c("stored") * F.coalesce("logical", F.lit(1))).alias("storage_model"),
        F.sum(F.when(bytes_ > 0, c("rows") * F.coalesce("flat", F.lit(0)))).alias("unpartitioned"),
    )
    wanted = {
        "time_travel": (2, "cost", fv.FINDING_TIME_TRAVEL),
        "unused_tables": (3, "cost", fv.FINDING_UNUSED),
        "storage_model": (5, "cost", fv.FINDING_STORAGE),
        "unpartitioned": (11, "performance", fv.FINDING_UNPARTITIONED),
    }
    return _rows(
        counts,
        *[
            _finding(seq, area, metric, _number(c(metric), limits.get(metric)), text)
            for metric, (seq, area, text) in wanted.items()
        ],
    )


def job_findings(
    jobs: DataFrame, as_of: datetime | None, limits: Mapping[str, int]
) -> DataFrame:
    """Forecast, top query, top error and slow queries from one pass over the jobs.

    Jobs collapse to one row per day and error reason first; the four findings
    are read from that small table, so the job history is scanned once and no
    SQL text is read.
    """
    end = resolve(as_of)
    c = F.col
    failed = c("error_result").isNotNull()
    slow = (
        performance.is_slow_candidate()
        & (c("creation_time") > F.lit(end - timedelta(days=fv.SCAN_SLOW_DAYS)))
    )
    digest = (
        last_days(jobs, "creation_time", end, 30)
        .groupBy(
            utc_date(c("creation_time")).alias("usage_date"),
            failed.alias("failed"),
            c("error_result.reason").alias("reason"),
        )
        .agg(
            F.sum("total_slot_ms").alias("slot_ms"),
            F.max("total_slot_ms").alias("max_slot_ms"),
            F.count(F.lit(1)).alias("jobs"),
            F.count_if(slow).alias("slow"),
        )
    )
    by_reason = Window.partitionBy("failed", "reason")
    ranked = digest.withColumn("reason_jobs", F.sum("jobs").over(by_reason))
    # Most frequent reason first, equal counts by name.
    error = F.min(F.when(c("failed"), F.struct(-c("reason_jobs"), c("reason").alias("reason"))))
    busy_days = F.count_distinct(F.when(c("slot_ms").isNotNull(), c("usage_date")))
    forecast = cost.daily_mean(
        F.sum("slot_ms"), busy_days, fv.MS_PER_HOUR, times=fv.FORECAST_DAYS
    )
    facts = ranked.agg(
        forecast.alias("forecast"),
        F.floor(slot_hours(F.max("max_slot_ms"))).alias("top_slot_hours"),
        error.alias("error"),
        F.sum("slow").alias("slow"),
    )
    labels = F.coalesce(c("error.reason"), F.lit("None"))
    for raw, label in fv.ERROR_LABELS.items():
        labels = F.when(c("error.reason") == raw, label).otherwise(labels)
    reason = F.when(c("error").isNotNull(), labels)
    slow_count = _number(c("slow"), limits.get("slow_queries"))
    return _rows(
        facts,
        _finding(1, "cost", "forecast", decimal_text(c("forecast")), fv.FINDING_FORECAST),
        _finding(
            4, "cost", "top_query", c("top_slot_hours").cast("string"), fv.FINDING_TOP_QUERY
        ),
        _finding(8, "performance", "top_error", reason, fv.FINDING_ERROR),
        _finding(10, "performance", "slow_queries", slow_count, fv.FINDING_SLOW),
    )


def public_finding(datasets: DataFrame) -> DataFrame:
    """Always one row: how many access entries are public, or that none is."""
    n = F.col("n")
    return governance.public_datasets(datasets).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(6).alias("seq"),
        F.lit("security").alias("area"),
        F.lit("public_datasets").alias("metric"),
        n.cast("string").alias("value"),
        F.when(n > 0, F.format_string(fv.FINDING_PUBLIC, n.cast("string")))
        .otherwise(fv.FINDING_NOT_PUBLIC)
        .alias("finding"),
    )


def saturation_finding(wh: Warehouse, project_id: str, as_of: datetime | None) -> DataFrame:
    """Status of the newest minute, unless it is OK."""
    newest = performance.slot_saturation(
        wh.jobs, wh.jobs_timeline, wh.reservations, wh.assignments, project_id, as_of, k=1
    ).where(F.col("health_status") != fv.STATUS_OK)
    return _rows(
        newest,
        _finding(
            9, "performance", "slot_health", F.col("health_status"), fv.FINDING_SLOT_HEALTH
        ),
    )


def environment_scan(
    wh: Warehouse,
    project_id: str,
    as_of: datetime | None = None,
    limits: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row (seq, area, metric, value, finding) per check that found something.

    Counts are exact. ``limits`` stops a metric's count at a number
    (``fixed_values.SCAN_LIMITS`` has the usual ones).

    Every branch ends in at most a few rows, so the union and its order are
    small whatever the size of the history; the branches are independent and
    run side by side.
    """
    limits = limits or {}
    branches = [
        job_findings(wh.jobs, as_of, limits),
        storage_findings(wh, as_of, limits),
        public_finding(wh.datasets),
        recommendation_findings(wh, limits),
        saturation_finding(wh, project_id, as_of),
    ]
    return reduce(DataFrame.unionByName, branches).orderBy("seq")


def scan_summary(scan: DataFrame) -> DataFrame:
    """All findings of a scan (twelve at most) in one line."""
    lines = F.array_sort(F.collect_list(F.struct("seq", "finding")))
    return scan.agg(
        F.array_join(lines["finding"], fv.FINDING_SEPARATOR).alias("summary")
    )
