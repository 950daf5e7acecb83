"""Every warehouse report by key, bound to a warehouse's views."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame

from slotledger.operators import (
    antipatterns,
    billing,
    cost,
    governance,
    layout,
    performance,
    recommendations,
    skew,
)
from slotledger.plans.scan import environment_scan
from slotledger.sources.warehouse import Warehouse

# key -> (report, names of the views it reads, whether it takes as_of)
_REPORTS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], bool]] = {
    "expensive_queries": (cost.expensive_queries, ("jobs",), True),
    "time_travel_consumers": (cost.time_travel_consumers, ("table_storage",), False),
    "forecast_monthly_costs": (cost.forecast_monthly_costs, ("jobs",), True),
    "large_unpartitioned_tables": (
        cost.large_unpartitioned_tables,
        ("table_storage", "tables"),
        False,
    ),
    "storage_compression_model": (
        cost.storage_compression_model,
        ("table_storage", "schemata_options"),
        False,
    ),
    "unused_tables": (cost.unused_tables, ("table_storage", "jobs"), True),
    "table_permissions": (governance.table_permissions, ("object_privileges",), False),
    "public_datasets": (governance.public_datasets, ("datasets",), False),
    "recent_table_users": (governance.recent_table_users, ("jobs",), True),
    "iam_recommendations": (
        recommendations.iam_recommendations,
        ("recommendations",),
        False,
    ),
    "partition_cluster_recommendations": (
        recommendations.partition_cluster_recommendations,
        ("recommendations",),
        False,
    ),
    "materialized_view_recommendations": (
        recommendations.materialized_view_recommendations,
        ("recommendations",),
        False,
    ),
    "common_query_errors": (performance.common_query_errors, ("jobs",), True),
    "hourly_slot_consumption": (performance.hourly_slot_consumption, ("jobs",), True),
    "frequent_tables": (performance.frequent_tables, ("jobs",), True),
    "slot_saturation": (
        performance.slot_saturation,
        ("jobs", "jobs_timeline", "reservations", "assignments"),
        True,
    ),
    "partition_key_candidates": (
        layout.partition_key_candidates,
        ("jobs", "table_storage", "tables"),
        True,
    ),
    "detect_antipatterns": (antipatterns.detect_antipatterns, ("jobs",), False),
    "antipattern_queries": (antipatterns.antipattern_queries, ("jobs",), True),
    "slow_queries": (performance.slow_queries, ("jobs",), True),
    "data_skew": (skew.data_skew, ("jobs", "jobs_timeline"), True),
    "job_diagnosis": (skew.job_diagnosis, ("jobs", "jobs_timeline"), True),
    "job_wait": (performance.job_wait, ("jobs",), True),
    "billing_by_service_sku": (billing.billing_by_service_sku, ("billing_export",), True),
}
REPORT_KEYS = (*_REPORTS, "environment_scan")


def run_report(
    wh: Warehouse, key: str, as_of: datetime | None = None, **params
) -> DataFrame:
    """The report named ``key``; ``params`` are the report's own arguments."""
    if key == "environment_scan":
        return environment_scan(wh, as_of=as_of, **params)
    report, views, timed = _REPORTS[key]
    if timed:
        params["as_of"] = as_of
    return report(*[wh[name] for name in views], **params)
