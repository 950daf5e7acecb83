from __future__ import annotations

import datetime as dt

from slotledger.operators import cost

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
DAY = dt.timedelta(days=1)


def job(job_id, created, **rest):
    return {"job_id": job_id, "creation_time": created, **rest}


def ref(dataset, table):
    return ("proj", dataset, table)


def test_window_start_is_excluded(frame):
    jobs = frame(
        "jobs",
        [
            job("at_start", AS_OF - 30 * DAY, total_slot_ms=3),
            job("inside", AS_OF - 30 * DAY + dt.timedelta(microseconds=1), total_slot_ms=2),
            job("later_than_as_of", AS_OF + DAY, total_slot_ms=1),
        ],
    )
    rows = cost.expensive_queries(jobs, AS_OF).collect()
    assert [r.job_id for r in rows] == ["inside"]


def test_expensive_queries_ties_and_nulls(frame):
    jobs = frame(
        "jobs",
        [job(name, AS_OF - DAY, total_slot_ms=ms) for name, ms in
         [("c", 7_200_000), ("a", 7_200_000), ("n", None), ("b", 3_600_000)]],
    )
    rows = cost.expensive_queries(jobs, AS_OF, k=4).collect()
    assert [(r.job_id, r.slot_hours) for r in rows] == [
        ("a", 2.0), ("c", 2.0), ("b", 1.0), ("n", None),
    ]


def test_naive_as_of_is_utc(frame):
    jobs = frame("jobs", [job("a", AS_OF - DAY / 2, total_slot_ms=1)])
    naive = AS_OF.replace(tzinfo=None)
    assert cost.expensive_queries(jobs, naive, days=1).count() == 1


def test_forecast_averages_only_days_with_jobs(frame):
    jobs = frame(
        "jobs",
        [
            job("a", AS_OF - 3 * DAY, total_slot_ms=3_600_000, total_bytes_billed=2**40),
            job("b", AS_OF - 3 * DAY, total_slot_ms=3_600_000, total_bytes_billed=2**40),
            job("c", AS_OF - 9 * DAY, total_slot_ms=14_400_000, total_bytes_billed=2**40),
        ],
    )
    row = cost.forecast_monthly_costs(jobs, AS_OF, days=20).first()
    assert row.avg_daily_slot_hours == 3.0
    assert row.avg_daily_tb_billed == 1.5
    assert row.forecasted_monthly_slot_hours == 90.0
    assert row.note == "Projections based on last 20 days average"


def test_forecast_without_jobs_is_one_row_of_nulls(frame):
    row = cost.forecast_monthly_costs(frame("jobs", []), AS_OF).first()
    assert row.avg_daily_slot_hours is None


def test_unknown_ddl_is_left_out(frame):
    names = [{"table_schema": "d", "table_name": n} for n in "abc"]
    storage = frame("table_storage", [{**n, "total_logical_bytes": 5} for n in names])
    ddls = ["CREATE TABLE x", None, "CREATE TABLE x PARTITION BY d"]
    tables = frame("tables", [{**n, "ddl": d} for n, d in zip(names, ddls)])
    rows = cost.large_unpartitioned_tables(storage, tables).collect()
    assert [r.table_name for r in rows] == ["a"]


def test_storage_model_keeps_logical_and_unset_datasets(frame):
    gib = 2**30
    sizes = dict(
        total_logical_bytes=300 * gib, active_logical_bytes=100 * gib,
        long_term_logical_bytes=200 * gib, total_physical_bytes=60 * gib,
        active_physical_bytes=20 * gib, long_term_physical_bytes=30 * gib,
        time_travel_physical_bytes=10 * gib, fail_safe_physical_bytes=5 * gib,
    )
    storage = frame(
        "table_storage",
        [{"table_schema": s, "table_name": "t", **sizes} for s in ("log", "phy", "unset")],
    )
    options = frame(
        "schemata_options",
        [
            {"schema_name": "log", "option_name": "storage_billing_model", "option_value": "LOGICAL"},
            {"schema_name": "phy", "option_name": "storage_billing_model", "option_value": "PHYSICAL"},
            {"schema_name": "unset", "option_name": "location", "option_value": "PHYSICAL"},
        ],
    )
    rows = cost.storage_compression_model(storage, options).collect()
    assert [r.table_schema for r in rows] == ["log", "unset"]
    row = rows[0]
    assert row.current_monthly_cost_usd == 4.0
    assert row.estimated_physical_cost_usd == 2.0
    assert row.potential_savings_usd == 2.0
    assert row.normal_compression_ratio == 5.0
    assert row.effective_compression_ratio == 4.0
    assert row.total_physical_bytes_all_features == 75 * gib


def test_unused_tables_ignores_null_and_empty_references(frame):
    storage = frame(
        "table_storage",
        [{"table_schema": "d", "table_name": n, "total_logical_bytes": b}
         for n, b in [("used", 9), ("old", 8), ("never", 7), ("empty", 0)]],
    )
    jobs = frame(
        "jobs",
        [
            job("1", AS_OF - DAY, referenced_tables=[ref("d", "used"), ref("other", "never")]),
            job("2", AS_OF - DAY, referenced_tables=[]),
            job("3", AS_OF - DAY),
            job("4", AS_OF - 200 * DAY, referenced_tables=[ref("d", "old")]),
        ],
    )
    rows = cost.unused_tables(storage, jobs, AS_OF).collect()
    assert [r.table_name for r in rows] == ["old", "never"]
    rows = cost.unused_tables(storage, jobs, AS_OF, days_inactive=365).collect()
    assert [r.table_name for r in rows] == ["never"]


def test_time_travel_share_of_an_empty_table_is_null(frame):
    storage = frame(
        "table_storage",
        [{"table_schema": "d", "table_name": "t", "total_physical_bytes": 0,
          "time_travel_physical_bytes": 1}],
    )
    assert cost.time_travel_consumers(storage).first().time_travel_pct is None
