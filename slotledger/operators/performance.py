"""Performance reports: errors, load, popular tables, saturation, slow jobs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger import fixed_values as fv
from slotledger.functions.clock import (
    between,
    last_days,
    millis_between,
    resolve,
    seconds_between,
    utc_hour,
    utc_minute,
)
from slotledger.functions.measures import gib, slot_hours, to_whole
from slotledger.functions.topk import top
from slotledger.operators.cost import table_references


def errors_by_reason(jobs: DataFrame) -> DataFrame:
    """``reason, error_count`` of failed jobs."""
    return (
        jobs.where(F.col("error_result").isNotNull())
        .groupBy(F.col("error_result.reason").alias("reason"))
        .agg(F.count(F.lit(1)).alias("error_count"))
    )


def most_frequent_errors(counted: DataFrame, k: int | None) -> DataFrame:
    return top(counted, k, F.desc("error_count"), F.col("reason"))


def common_query_errors(
    jobs: DataFrame, as_of: datetime | None = None, days: int = 30, k: int = 10
) -> DataFrame:
    """Most frequent error reasons."""
    return most_frequent_errors(errors_by_reason(last_days(jobs, "creation_time", as_of, days)), k)


def hourly_slots(usage: DataFrame) -> DataFrame:
    """Slot hours by hour of day, busiest first, of sums with an ``hour_of_day``."""
    hourly = usage.groupBy("hour_of_day").agg(
        slot_hours(F.sum("slot_ms")).alias("total_slot_hours")
    )
    return top(hourly, None, F.desc("total_slot_hours"), F.col("hour_of_day"))


def hourly_slot_consumption(
    jobs: DataFrame, as_of: datetime | None = None, days: int = 30
) -> DataFrame:
    """Slot hours by hour of day, busiest first."""
    recent = last_days(jobs, "creation_time", as_of, days)
    hour = utc_hour(F.col("creation_time")).alias("hour_of_day")
    return hourly_slots(recent.select(hour, F.col("total_slot_ms").alias("slot_ms")))


def reference_counts(jobs: DataFrame) -> DataFrame:
    """``table_id, dataset_id, query_count`` of the tables that jobs read."""
    return (
        table_references(jobs)
        .groupBy("table_id", "dataset_id")
        .agg(F.count(F.lit(1)).alias("query_count"))
    )


def most_read_tables(counted: DataFrame, k: int | None) -> DataFrame:
    return top(counted, k, F.desc("query_count"), F.col("table_id"), F.col("dataset_id"))


def frequent_tables(
    jobs: DataFrame, as_of: datetime | None = None, days: int = 30, k: int = 20
) -> DataFrame:
    """Tables referenced most often."""
    return most_read_tables(reference_counts(last_days(jobs, "creation_time", as_of, days)), k)


def slot_limit(
    reservations: DataFrame,
    assignments: DataFrame,
    project_id: str,
    default: int = fv.DEFAULT_SLOT_LIMIT,
) -> DataFrame:
    """One row, ``system_slot_limit``: capacity of the reservation assigned for queries.

    Several such assignments are an error, as they leave the limit undefined.
    """
    assigned = (
        assignments.where((F.col("project_id") == project_id) & (F.col("job_type") == "QUERY"))
        .select("reservation_name")
        .scalar()
    )
    burst = F.coalesce(F.col("autoscale.max_slots"), F.lit(0))
    return reservations.where(F.col("reservation_name") == assigned).agg(
        F.coalesce(F.sum(F.col("slot_capacity") + burst), F.lit(default).cast("bigint")).alias(
            "system_slot_limit"
        )
    )


def mean_slots() -> Column:
    """Mean slots in use over a minute's periods, rounded to whole slots."""
    return to_whole(F.sum("period_slot_ms") / F.lit(float(fv.MS_PER_MINUTE)))


def is_query() -> Column:
    return F.col("job_type") == "QUERY"


def wait_measures() -> tuple[Column, Column]:
    """``jobs_submitted`` and their mean wait in seconds, ``avg_wait_sec``.

    The mean is one division of whole-number sums, so it does not depend on the
    order in which partial sums meet.
    """
    waited = millis_between(F.col("creation_time"), F.col("start_time"))
    mean = F.try_divide(F.sum(waited), F.count(waited) * fv.MS_PER_SECOND)
    return F.count("job_id").alias("jobs_submitted"), F.round(mean, 2).alias("avg_wait_sec")


def slots_by_minute(timeline: DataFrame) -> DataFrame:
    """Mean slots in use per minute."""
    minute = utc_minute(F.col("period_start")).alias("time_bucket")
    return timeline.groupBy(minute).agg(mean_slots().alias("avg_slots_used"))


def waits_by_minute(jobs: DataFrame) -> DataFrame:
    """Query jobs submitted per minute and their mean wait."""
    minute = utc_minute(F.col("creation_time")).alias("time_bucket")
    return jobs.where(is_query()).groupBy(minute).agg(*wait_measures())


def health_status(wait_sec: Column, slots: Column, limit: Column) -> Column:
    """Status of a minute from its (rounded) mean wait and its slot use."""
    waiting = wait_sec > fv.WAIT_THRESHOLD_SEC
    return (
        F.when(waiting & (slots > limit * fv.HIGH_USAGE), fv.STATUS_CRITICAL)
        .when(waiting & (slots < limit * fv.LOW_USAGE), fv.STATUS_QUEUING)
        .otherwise(fv.STATUS_OK)
    )


def judged_minutes(minutes: DataFrame) -> DataFrame:
    """Minutes with their slot use in per cent of the limit and their status."""
    used, cap = F.col("avg_slots_used"), F.col("system_slot_limit")
    return minutes.select(
        "time_bucket",
        "avg_slots_used",
        "system_slot_limit",
        F.round(F.try_divide(used.cast("double"), cap.cast("double")) * 100, 1).alias(
            "capacity_used_pct"
        ),
        "jobs_submitted",
        "avg_wait_sec",
        health_status(F.col("avg_wait_sec"), used, cap).alias("health_status"),
    )


def slot_saturation(
    jobs: DataFrame,
    jobs_timeline: DataFrame,
    reservations: DataFrame,
    assignments: DataFrame,
    project_id: str,
    as_of: datetime | None = None,
    hours: int | None = fv.SATURATION_HOURS,
    k: int | None = 100,
) -> DataFrame:
    """Slot use against the limit per minute, newest first; the whole history without ``hours``."""
    end = resolve(as_of)
    start = None if hours is None else end - timedelta(hours=hours)
    usage = slots_by_minute(between(jobs_timeline, "period_start", start, end))
    waits = waits_by_minute(between(jobs, "creation_time", start, end))
    # A global aggregate: exactly one row, whatever the input.
    limit = slot_limit(reservations, assignments, project_id)
    minutes = usage.join(waits, "time_bucket", "left").crossJoin(F.broadcast(limit))
    return judged_minutes(top(minutes, k, F.desc("time_bucket")))


def is_slow_candidate() -> Column:
    """Finished SELECT queries."""
    return (
        (F.col("job_type") == "QUERY")
        & (F.col("statement_type") == "SELECT")
        & F.col("error_result").isNull()
    )


def slow_queries(
    jobs: DataFrame,
    as_of: datetime | None = None,
    days: int = 7,
    k: int | None = 10,
    snippet_chars: int | None = fv.SNIPPET_CHARS,
) -> DataFrame:
    """Successful SELECT queries that ran longest, with the first characters of their text
    (the whole text when ``snippet_chars`` is None)."""
    finished = (
        last_days(jobs, "creation_time", as_of, days)
        .where(is_slow_candidate())
        .withColumn(
            "duration_seconds", seconds_between(F.col("start_time"), F.col("end_time"))
        )
    )
    return top(finished, k, F.desc("duration_seconds"), F.col("job_id")).select(
        "job_id",
        "user_email",
        "duration_seconds",
        slot_hours(F.col("total_slot_ms")).alias("slot_hours"),
        (F.col("query") if snippet_chars is None else F.left("query", F.lit(snippet_chars))).alias(
            "query_snippet"
        ),
        gib(F.col("total_bytes_processed")).alias("gb_processed"),
    )


def job_wait(
    jobs: DataFrame,
    job_id: str | None = None,
    as_of: datetime | None = None,
    days: int | None = None,
    carry: tuple[Column, ...] = (),
) -> DataFrame:
    """Wait before start and main facts, of one job or of all; of the last ``days`` if given."""
    jobs = last_days(jobs, "creation_time", as_of, days)
    if job_id is not None:
        jobs = jobs.where(F.col("job_id") == job_id)
    return jobs.select(
        "job_id",
        "user_email",
        "query",
        "total_bytes_processed",
        seconds_between(F.col("creation_time"), F.col("start_time")).alias("avg_wait_sec"),
        "total_slot_ms",
        *carry,
    )
