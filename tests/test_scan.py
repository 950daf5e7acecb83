from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from slotledger import fixed_values as fv
from slotledger.plans.reports import REPORT_KEYS, run_report
from slotledger.plans.scan import environment_scan, scan_summary
from slotledger.sources.driver_tables import AS_OF, PROJECT_ID
from slotledger.sources.warehouse import Warehouse


def test_scan_agrees_with_the_reports(warehouse):
    rows = {r.seq: r for r in environment_scan(warehouse, PROJECT_ID, AS_OF).collect()}

    def report(key, **params):
        return run_report(warehouse, key, as_of=AS_OF, **params)

    def size(key, **params):
        return str(report(key, k=None, **params).count())

    assert rows[1].value == str(
        report("forecast_monthly_costs").first().forecasted_monthly_slot_hours)
    assert rows[2].value == size("time_travel_consumers")
    assert rows[3].value == size("unused_tables", days_inactive=30)
    assert rows[4].value == str(int(report("expensive_queries").first().slot_hours))
    assert rows[5].value == size("storage_compression_model")
    assert rows[6].value == str(report("public_datasets").count())
    assert rows[7].value == size("iam_recommendations")
    top = report("common_query_errors").first().reason
    assert rows[8].value == {"notFound": "Not Found"}.get(top, top)
    health = report("slot_saturation", project_id=PROJECT_ID).first().health_status
    assert (9 in rows) == (health != "OK")
    assert rows[10].value == size("slow_queries")
    assert rows[11].value == size("large_unpartitioned_tables")
    assert rows[12].value == size("partition_cluster_recommendations")
    assert [r.seq for r in rows.values()] == sorted(rows)
    limited = environment_scan(warehouse, PROJECT_ID, AS_OF, limits=fv.SCAN_LIMITS).collect()
    wanted = {metric: row.value for metric, row in ((r.metric, r) for r in rows.values())}
    for row in limited:
        limit = fv.SCAN_LIMITS.get(row.metric)
        full = wanted[row.metric]
        assert row.value == (full if limit is None else str(min(int(full), limit)))


def empty_views(frame, **views):
    from slotledger.schemas import VIEWS

    return {view: views.get(view, frame(view, [])) for view in VIEWS}


def test_scan_of_an_empty_warehouse(spark, frame):
    wh = Warehouse.from_frames(spark, **empty_views(frame))
    rows = environment_scan(wh, PROJECT_ID, AS_OF).collect()
    assert [r.finding for r in rows] == ["Security: No public datasets found."]


def test_scan_reports_saturation_and_formats_numbers(spark, frame):
    minute = AS_OF - dt.timedelta(minutes=1)
    jobs = frame("jobs", [
        {"job_id": "a", "creation_time": minute, "job_type": "QUERY", "total_slot_ms": 3_600_000 * 7,
         "start_time": minute + dt.timedelta(seconds=9), "error_result": (None, "m")},
        {"job_id": "b", "creation_time": AS_OF - dt.timedelta(days=2), "total_slot_ms": 1}])
    timeline = frame("jobs_timeline", [
        {"job_id": "a", "period_start": minute, "period_slot_ms": 60_000 * 1900}])
    wh = Warehouse.from_frames(spark, **empty_views(frame, jobs=jobs, jobs_timeline=timeline))
    scan = environment_scan(wh, PROJECT_ID, AS_OF)
    assert scan_summary(scan).first().summary == (
        "Projected Monthly Slot Hours: 105.0 | Top Query Cost: 7 slot hrs | "
        "Security: No public datasets found. | Top Query Error: None | "
        "Slot Health: CRITICAL: Saturation")


def test_large_forecast_is_not_in_exponent_form(spark, frame):
    jobs = frame("jobs", [
        {"job_id": "a", "creation_time": AS_OF - dt.timedelta(days=1), "total_slot_ms": 2**60}])
    wh = Warehouse.from_frames(spark, **empty_views(frame, jobs=jobs))
    row = environment_scan(wh, PROJECT_ID, AS_OF).where(F.col("seq") == 1).first()
    assert "E" not in row.value and float(row.value) == round(2**60 / 3.6e6 * 30, 2)


def test_every_report_key_runs(warehouse):
    params = {
        "slot_saturation": {"project_id": PROJECT_ID},
        "environment_scan": {"project_id": PROJECT_ID},
        "recent_table_users": {"table_name": "t_1"},
    }
    for key in REPORT_KEYS:
        assert run_report(warehouse, key, as_of=AS_OF, **params.get(key, {})).columns
