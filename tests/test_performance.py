from __future__ import annotations

import datetime as dt

import pytest

from slotledger.operators import layout, performance

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
DAY = dt.timedelta(days=1)
MIN = dt.timedelta(minutes=1)


def test_errors_count_a_null_reason(frame):
    def job(error):
        return {"job_id": "j", "creation_time": AS_OF - DAY, "error_result": error}

    jobs = frame("jobs", [job(("a", None)), job((None, "m")), job((None, "m")), job(None)])
    rows = performance.common_query_errors(jobs, AS_OF).collect()
    assert [(r.reason, r.error_count) for r in rows] == [(None, 2), ("a", 1)]


def test_hour_of_day_is_utc_in_any_session_zone(spark, frame):
    created = dt.datetime(2024, 1, 30, 23, 30, tzinfo=dt.timezone.utc)
    jobs = frame("jobs", [{"job_id": "j", "creation_time": created, "total_slot_ms": 1}])
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        row = performance.hourly_slot_consumption(jobs, AS_OF).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.hour_of_day == 23


def test_frequent_tables_counts_references_not_jobs(frame):
    refs = [("p", "d", "t"), ("p", "d", "t"), ("p", "e", "t")]
    jobs = frame("jobs", [{"job_id": "j", "creation_time": AS_OF - DAY, "referenced_tables": refs}])
    rows = performance.frequent_tables(jobs, AS_OF).collect()
    assert [(r.table_id, r.dataset_id, r.query_count) for r in rows] == [
        ("t", "d", 2), ("t", "e", 1),
    ]


@pytest.fixture
def load(frame):
    def build(slots_per_minute, wait_ms, job_type="QUERY"):
        timeline, jobs = [], []
        for i, slots in enumerate(slots_per_minute):
            at = AS_OF - (i + 1) * MIN
            timeline.append({"job_id": "j", "period_start": at, "period_slot_ms": slots * 60_000})
            jobs.append({"job_id": f"j{i}", "creation_time": at, "job_type": job_type,
                         "start_time": at + dt.timedelta(milliseconds=wait_ms)})
        return frame("jobs", jobs), frame("jobs_timeline", timeline)

    return build


def saturation(frame, load, reservations=(), assignments=(), k=100):
    r = frame("reservations", [
        {"reservation_name": n, "slot_capacity": c, "autoscale": a} for n, c, a in reservations])
    a = frame("assignments", [
        {"reservation_name": n, "project_id": p, "job_type": j} for n, p, j in assignments])
    return performance.slot_saturation(*load, r, a, "proj", AS_OF, k=k).collect()


def test_default_limit_and_status(frame, load):
    rows = saturation(frame, load([1801, 1800, 999, 1000], wait_ms=2010))
    assert {r.system_slot_limit for r in rows} == {2000}
    assert [r.health_status for r in rows] == [
        "CRITICAL: Saturation", "OK", "WARNING: Queuing (Concurrency)", "OK"]
    assert rows[0].capacity_used_pct == 90.1
    assert rows[0].time_bucket > rows[1].time_bucket


def test_wait_is_rounded_before_it_is_compared(frame, load):
    assert saturation(frame, load([1], 2004))[0].health_status == "OK"
    assert saturation(frame, load([1], 2005))[0].health_status.startswith("WARNING")


def test_limit_of_the_assigned_reservation(frame, load):
    reservations = [("r1", 100, (50,)), ("r1", 10, None), ("r2", 7, None)]
    assignments = [("r1", "proj", "QUERY"), ("r2", "proj", "PIPELINE"), ("r2", "other", "QUERY")]
    rows = saturation(frame, load([80], 0), reservations, assignments)
    assert rows[0].system_slot_limit == 160
    assert rows[0].capacity_used_pct == 50.0


def test_zero_capacity_gives_no_percentage(frame, load):
    rows = saturation(frame, load([80], 0), [("r", 0, None)], [("r", "proj", "QUERY")])
    assert rows[0].system_slot_limit == 0 and rows[0].capacity_used_pct is None


def test_two_query_assignments_are_an_error(frame, load):
    assigned = [("r1", "proj", "QUERY"), ("r2", "proj", "QUERY")]
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        saturation(frame, load([1], 0), [("r1", 1, None)], assigned)


def test_minutes_without_query_jobs_keep_their_row(frame, load):
    rows = saturation(frame, load([1, 2], 5000, job_type="LOAD"))
    assert [(r.jobs_submitted, r.avg_wait_sec, r.health_status) for r in rows] == [
        (None, None, "OK")] * 2


def test_only_six_hours_and_the_newest_minutes(frame, load):
    jobs, timeline = load([1] * 400, 0)
    assert len(saturation(frame, (jobs, timeline), k=1000)) == 359
    assert len(saturation(frame, (jobs, timeline))) == 100


def test_slots_round_half_away_from_zero(frame):
    timeline = frame("jobs_timeline", [
        {"job_id": "j", "period_start": AS_OF, "period_slot_ms": 150_000}])
    assert performance.slots_by_minute(timeline).first().avg_slots_used == 3


def test_slow_queries(frame):
    def job(job_id, ms, **rest):
        start = AS_OF - DAY
        return {"job_id": job_id, "creation_time": start, "start_time": start, "query": "x" * 300,
                "end_time": start + dt.timedelta(milliseconds=ms), "job_type": "QUERY",
                "statement_type": "SELECT", **rest}

    jobs = frame("jobs", [
        job("a", 1500), job("b", 2500), job("failed", 9000, error_result=(None, None)),
        job("load", 9000, job_type="LOAD"), job("dml", 9000, statement_type="INSERT")])
    rows = performance.slow_queries(jobs, AS_OF).collect()
    assert [(r.job_id, r.duration_seconds) for r in rows] == [("b", 2.5), ("a", 1.5)]
    assert len(rows[0].query_snippet) == 200


def partition_candidates(frame, **options):
    def named(schema, table):
        return {"table_schema": schema, "table_name": table}

    sizes = [("d", "big", 50), ("e", "big", 40), ("d", "mid", 30), ("d", "low", 20), ("d", "tiny", 5)]
    storage = frame("table_storage", [
        {**named(s, t), "total_logical_bytes": g * 2**30} for s, t, g in sizes])
    tables = frame("tables", [{**named(s, t), "ddl": "CREATE TABLE"} for s, t, _ in sizes])
    jobs = frame("jobs", [
        {"job_id": f"j{i}", "creation_time": AS_OF - DAY, "statement_type": "SELECT",
         "query": f"q{i}", "total_slot_ms": i, "referenced_tables": [("p", "d", t)]}
        for i, t in enumerate(["big"] * 4 + ["mid"] * 2 + ["low"])])
    return layout.partition_key_candidates(jobs, storage, tables, AS_OF, **options).collect()


def test_partition_candidates_match_by_name_only(frame):
    rows = partition_candidates(frame)
    assert sorted((r.table_name, r.size_gb, r.query) for r in rows) == [
        ("big", 40.0, "q3"), ("big", 50.0, "q2"), ("big", 50.0, "q3"),
        ("mid", 30.0, "q4"), ("mid", 30.0, "q5")]


def test_partition_candidates_may_match_the_dataset(frame):
    rows = partition_candidates(frame, match_dataset=True)
    assert sorted((r.table_name, r.query) for r in rows) == [
        ("big", "q1"), ("big", "q2"), ("big", "q3"), ("mid", "q4"), ("mid", "q5")]
