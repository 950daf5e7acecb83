"""Cost reports: slot use, forecast, storage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger import fixed_values as fv
from slotledger.functions.clock import last_days, utc_date, utc_hour
from slotledger.functions.measures import gib, ratio, slot_hours
from slotledger.functions.topk import top


def expensive_queries(
    jobs: DataFrame, as_of: datetime | None = None, days: int = 30, k: int = 10
) -> DataFrame:
    """Jobs with the most slot time."""
    recent = last_days(jobs, "creation_time", as_of, days)
    return top(recent, k, F.desc("total_slot_ms"), F.col("job_id")).select(
        "job_id", "query", slot_hours(F.col("total_slot_ms")).alias("slot_hours")
    )


def has_time_travel() -> Column:
    return F.col("time_travel_physical_bytes") > 0


def time_travel_consumers(table_storage: DataFrame, k: int = 20) -> DataFrame:
    """Tables with the most time-travel storage."""
    kept, total = F.col("time_travel_physical_bytes"), F.col("total_physical_bytes")
    return top(
        table_storage.where(has_time_travel()),
        k,
        F.desc("time_travel_physical_bytes"),
        F.col("table_schema"),
        F.col("table_name"),
    ).select(
        F.col("table_schema").alias("dataset"),
        "table_name",
        gib(total).alias("total_gb"),
        gib(kept).alias("time_travel_gb"),
        F.round(ratio(kept, total) * 100, 2).alias("time_travel_pct"),
    )


def daily_mean(total: Column, days: Column, unit: int, times: int = 1) -> Column:
    """``times`` the mean of ``total`` over ``days``, in ``unit``s, rounded to 2 places.

    One division of whole numbers: a mean of per-day fractions would depend, in
    the digit that decides the rounding, on the order in which they are added.
    """
    return F.round(F.try_divide(total * F.lit(float(times)), days * F.lit(float(unit))), 2)


def usage_by_hour(jobs: DataFrame) -> DataFrame:
    """``usage_date, hour_of_day, slot_ms, billed``: sums that add up over any set of jobs."""
    time = F.col("creation_time")
    return jobs.groupBy(utc_date(time).alias("usage_date"), utc_hour(time).alias("hour_of_day")).agg(
        F.sum("total_slot_ms").alias("slot_ms"), F.sum("total_bytes_billed").alias("billed")
    )


def forecast_of(usage: DataFrame, days: int) -> DataFrame:
    """Projection from sums with a ``usage_date``."""
    daily = usage.groupBy("usage_date").agg(
        F.sum("slot_ms").alias("slot_ms"), F.sum("billed").alias("billed")
    )
    slots = (F.sum("slot_ms"), F.count("slot_ms"), fv.MS_PER_HOUR)
    billed = (F.sum("billed"), F.count("billed"), fv.BYTES_PER_TIB)
    month = fv.FORECAST_DAYS
    return daily.agg(
        daily_mean(*slots).alias("avg_daily_slot_hours"),
        daily_mean(*billed).alias("avg_daily_tb_billed"),
        daily_mean(*slots, times=month).alias("forecasted_monthly_slot_hours"),
        daily_mean(*billed, times=month).alias("forecasted_monthly_tb_billed"),
        F.lit(fv.FORECAST_NOTE % days).alias("note"),
    )


def forecast_monthly_costs(
    jobs: DataFrame, as_of: datetime | None = None, days: int = 30
) -> DataFrame:
    """Monthly projection from the mean of the days that have jobs (one row)."""
    recent = last_days(jobs, "creation_time", as_of, days)
    usage = recent.select(
        utc_date(F.col("creation_time")).alias("usage_date"),
        F.col("total_slot_ms").alias("slot_ms"),
        F.col("total_bytes_billed").alias("billed"),
    )
    return forecast_of(usage, days)


def unpartitioned_tables(
    table_storage: DataFrame, tables: DataFrame, min_bytes: int = 0
) -> DataFrame:
    """Tables above a size whose DDL has no partition clause (unknown DDL is left out)."""
    large = table_storage.where(F.col("total_logical_bytes") > min_bytes).select(
        "table_schema", "table_name", "total_logical_bytes"
    )
    return large.join(flat_tables(tables), ["table_schema", "table_name"])


def flat_tables(tables: DataFrame) -> DataFrame:
    """Names of tables whose DDL has no partition clause."""
    flat = tables.where(~F.col("ddl").like(fv.PARTITION_CLAUSE_PATTERN))
    return flat.select("table_schema", "table_name")


def large_unpartitioned_tables(
    table_storage: DataFrame, tables: DataFrame, k: int = 20
) -> DataFrame:
    """Largest tables without partitioning."""
    return top(
        unpartitioned_tables(table_storage, tables),
        k,
        F.desc("total_logical_bytes"),
        F.col("table_schema"),
        F.col("table_name"),
    )


def logically_billed_tables(
    table_storage: DataFrame, schemata_options: DataFrame
) -> DataFrame:
    """Stored tables of datasets billed by logical bytes, or with no billing option."""
    models = billing_models(schemata_options)
    return table_storage.where(is_stored()).join(models, "table_schema", "left").where(
        is_billed_logically()
    )


def is_stored() -> Column:
    return F.col("total_physical_bytes") > 0


def billing_models(schemata_options: DataFrame) -> DataFrame:
    """``table_schema, billing_model`` of the datasets that have the option."""
    return schemata_options.where(F.col("option_name") == fv.BILLING_MODEL_OPTION).select(
        F.col("schema_name").alias("table_schema"), F.col("option_value").alias("billing_model")
    )


def is_billed_logically() -> Column:
    model = F.col("billing_model")
    return model.isNull() | (model == fv.LOGICAL_BILLING)


def storage_compression_model(
    table_storage: DataFrame,
    schemata_options: DataFrame,
    k: int = 20,
    logical_active: float = fv.LOGICAL_ACTIVE_PRICE,
    logical_long_term: float = fv.LOGICAL_LONG_TERM_PRICE,
    physical_active: float = fv.PHYSICAL_ACTIVE_PRICE,
    physical_long_term: float = fv.PHYSICAL_LONG_TERM_PRICE,
) -> DataFrame:
    """Monthly cost under logical and physical billing, best savings first."""
    c = F.col
    retained = c("time_travel_physical_bytes") + c("fail_safe_physical_bytes")
    # Time-travel and fail-safe bytes come on top of the physical total.
    everything = (
        c("total_physical_bytes") + c("time_travel_physical_bytes") + c("fail_safe_physical_bytes")
    )
    logical_cost = gib(c("active_logical_bytes")) * logical_active + (
        gib(c("long_term_logical_bytes")) * logical_long_term
    )
    physical_cost = (
        gib(c("active_physical_bytes")) * physical_active
        + gib(c("long_term_physical_bytes")) * physical_long_term
        + gib(retained) * physical_active
    )
    costed = logically_billed_tables(table_storage, schemata_options).select(
        "table_schema",
        "table_name",
        F.round(ratio(c("total_logical_bytes"), c("total_physical_bytes")), 2).alias(
            "normal_compression_ratio"
        ),
        F.round(ratio(c("total_logical_bytes"), everything), 2).alias(
            "effective_compression_ratio"
        ),
        F.round(logical_cost, 2).alias("current_monthly_cost_usd"),
        F.round(physical_cost, 2).alias("estimated_physical_cost_usd"),
        F.round(logical_cost - physical_cost, 2).alias("potential_savings_usd"),
        F.lit(fv.PRICING_NOTE).alias("pricing_note"),
        "total_logical_bytes",
        everything.alias("total_physical_bytes_all_features"),
    )
    # The order is that of the rounded savings.
    return top(
        costed, k, F.desc("potential_savings_usd"), c("table_schema"), c("table_name")
    )


def table_references(jobs: DataFrame, *carry: str) -> DataFrame:
    """One row per table reference of a job: ``carry`` columns, dataset_id, table_id.

    Only the two name leaves of the reference array are kept before it is
    exploded, so the scan reads no other leaf.
    """
    names = F.arrays_zip(
        F.col("referenced_tables.dataset_id").alias("dataset_id"),
        F.col("referenced_tables.table_id").alias("table_id"),
    )
    return jobs.select(*carry, F.inline(names))


def used_tables(jobs: DataFrame, as_of: datetime | None, days: int) -> DataFrame:
    """Names of the tables that jobs of the last ``days`` read, each once."""
    return names_of(table_references(last_days(jobs, "creation_time", as_of, days)))


def names_of(references: DataFrame) -> DataFrame:
    """The tables of some references, each once."""
    return references.select(
        F.col("dataset_id").alias("table_schema"), F.col("table_id").alias("table_name")
    ).distinct()


def stored_but_not(table_storage: DataFrame, used: DataFrame) -> DataFrame:
    """Non-empty tables that are not among the ``used`` ones."""
    stored = table_storage.where(F.col("total_logical_bytes") > 0).select(
        "table_schema", "table_name", "total_logical_bytes"
    )
    return stored.join(used, ["table_schema", "table_name"], "left_anti").distinct()


def unreferenced_tables(
    table_storage: DataFrame, jobs: DataFrame, as_of: datetime | None, days: int
) -> DataFrame:
    """Non-empty tables that no job of the last ``days`` read.

    References collapse to distinct names on the map side before they are
    shuffled, so a table that most jobs read costs one row per task.
    """
    return stored_but_not(table_storage, used_tables(jobs, as_of, days))


def largest_tables(found: DataFrame, k: int | None) -> DataFrame:
    return top(
        found, k, F.desc("total_logical_bytes"), F.col("table_schema"), F.col("table_name")
    )


def unused_tables(
    table_storage: DataFrame,
    jobs: DataFrame,
    as_of: datetime | None = None,
    days_inactive: int = 180,
    k: int = 50,
) -> DataFrame:
    """Largest tables not read for ``days_inactive`` days."""
    return largest_tables(unreferenced_tables(table_storage, jobs, as_of, days_inactive), k)
