"""Billing export reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.functions.clock import last_days, utc_date


def billing_by_service_sku(
    billing_export: DataFrame, as_of: datetime | None = None, days: int | None = None
) -> DataFrame:
    """Cost by service, SKU and day; of the last ``days`` if given.

    Costs are added as decimals, so the sum does not depend on their order.
    """
    exact = F.col("cost").cast("decimal(28,10)")
    return last_days(billing_export, "usage_start_time", as_of, days).groupBy(
        F.col("service.description").alias("service"),
        F.col("sku.description").alias("sku"),
        utc_date(F.col("usage_start_time")).alias("usage_date"),
    ).agg(F.sum(exact).cast("double").alias("cost"))
