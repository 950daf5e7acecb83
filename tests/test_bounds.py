"""Optional limits, closed time windows, and sinks that keep keys."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotledger import sinks
from slotledger.functions.clock import last_days
from slotledger.operators import governance, layout, performance, transcripts
from slotledger.plans.adhoc import adhoc_sql
from slotledger.plans.reports import run_report
from slotledger.sources.driver_tables import PAST_AS_OF, PROJECT_ID
from slotledger.sources.warehouse import Warehouse

WINDOWED = {
    "expensive_queries": {},
    "forecast_monthly_costs": {},
    "unused_tables": {},
    "recent_table_users": {"table_name": "t_1"},
    "common_query_errors": {},
    "hourly_slot_consumption": {},
    "frequent_tables": {},
    "slot_saturation": {"project_id": PROJECT_ID},
    "partition_key_candidates": {},
    "antipattern_queries": {},
    "slow_queries": {},
    "environment_scan": {"project_id": PROJECT_ID},
}


@pytest.fixture(scope="module")
def cut(spark, warehouse):
    """The history as it was at the earlier time."""
    times = {"jobs": "creation_time", "jobs_timeline": "period_start"}
    frames = {}
    for view in warehouse._loaders:
        frames[view] = warehouse[view]
        if view in times:
            frames[view] = frames[view].where(F.col(times[view]) <= F.lit(PAST_AS_OF))
    return Warehouse.from_frames(spark, **frames)


@pytest.mark.parametrize("key", sorted(WINDOWED))
def test_an_earlier_as_of_sees_no_later_row(warehouse, cut, key):
    def rows(wh):
        return [tuple(r) for r in run_report(wh, key, as_of=PAST_AS_OF, **WINDOWED[key]).collect()]

    assert sorted(rows(warehouse), key=repr) == sorted(rows(cut), key=repr)


def test_both_ends_prune_day_folders(spark):
    days = spark.range(10).select(
        F.timestamp_seconds(F.col("id") * 86400).alias("t"), F.date_from_unix_date(F.col("id").cast("int")).alias("dt")
    )
    found = last_days(days, "t", dt.datetime(1970, 1, 6), 3)
    assert found.count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "dt" in plan and "<=" in plan and ">=" in plan


def test_no_limit_gives_all_rows(warehouse):
    as_of = dt.datetime(2024, 1, 31)
    users = governance.recent_table_users(warehouse.jobs, "t_1", as_of, k=None)
    assert users.count() >= governance.recent_table_users(warehouse.jobs, "t_1", as_of).count() > 0
    views = (warehouse.jobs, warehouse.table_storage, warehouse.tables)
    few = layout.partition_key_candidates(*views, as_of=as_of)
    more = layout.partition_key_candidates(*views, as_of=as_of, k_queries=None)
    every = layout.partition_key_candidates(*views, as_of=as_of, k_queries=None, k_tables=None)
    assert 0 < few.count() <= more.count() <= every.count()
    many = layout.partition_key_candidates(*views, as_of=as_of, k_tables=10**6)
    assert "strategy=broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_snippets_are_cut_or_whole(frame):
    time = dt.datetime(2024, 1, 30)
    jobs = frame("jobs", [{"job_id": "a", "creation_time": time, "start_time": time, "end_time": time,
                           "job_type": "QUERY", "statement_type": "SELECT", "query": "x" * 500}])
    as_of = dt.datetime(2024, 1, 31)
    for chars, length in ((200, 200), (3, 3), (None, 500)):
        row = performance.slow_queries(jobs, as_of, snippet_chars=chars).first()
        assert len(row["query_snippet"]) == length


def test_many_uses_in_one_minute(spark, frame):
    start = dt.datetime(2024, 1, 30, 12, 0, tzinfo=dt.timezone.utc)
    rows = [{"job_id": str(i), "user_email": f"u{i % 3}", "query": f"q{i}", "creation_time": start + dt.timedelta(milliseconds=i),
             "referenced_tables": [("p", "d", "t")]} for i in range(2000)]
    found = governance.recent_table_users(frame("jobs", rows), "t", dt.datetime(2024, 1, 31), k=5).collect()
    assert [r["query"] for r in found] == [f"q{i}" for i in range(1999, 1994, -1)]


def test_tables_are_written_by_title(spark, warehouse, tmp_path):
    latest = transcripts.latest_tables(transcripts.tool_tables(warehouse.agent_events))
    sinks.write_tables_by_title(latest, str(tmp_path / "tables"))
    back = spark.read.text(str(tmp_path / "tables"))
    assert back.count() == latest.agg(F.sum(F.size("records"))).first()[0]
    assert back.select("title").distinct().count() == latest.select("title").distinct().count()


def test_refresh_sees_new_files(spark, tmp_path, frame):
    rows = frame("reservations", [{"reservation_name": "a", "slot_capacity": 1}])
    rows.write.parquet(f"{tmp_path}/reservations")
    wh = Warehouse.from_path(spark, str(tmp_path))
    assert wh.reservations.count() == 1
    rows.write.mode("append").parquet(f"{tmp_path}/reservations")
    wh.refresh()
    assert wh.reservations.count() == 2


def test_adhoc_sql_leaves_own_views_alone(spark, frame):
    wh = Warehouse.from_frames(spark, assignments=frame("assignments", []))
    spark.range(3).createOrReplaceTempView("own_assignments")
    with pytest.raises(ValueError):
        adhoc_sql(wh, "SELECT 1", prefix="own_")
    assert adhoc_sql(wh, "SELECT count(*) AS n FROM w_assignments", prefix="w_").first()["n"] == 0
    assert spark.table("own_assignments").count() == 3
