"""The saturation stream against the report over the same history."""

from __future__ import annotations

import random
from pathlib import Path
from datetime import datetime, timedelta, timezone

import pytest

from slotledger.operators import performance
from slotledger.streaming import saturation

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
END = datetime(2030, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def histories(frame):
    """Jobs and periods in chunks of rising time, rows inside a chunk and near its edges mixed."""
    rnd = random.Random(3)
    jobs, periods = [], []
    for i in range(900):
        at = START + timedelta(seconds=rnd.randrange(3 * 3600), milliseconds=rnd.randrange(1000))
        waited = timedelta(milliseconds=rnd.randrange(20_000))
        jobs.append({"job_id": f"j{i}", "creation_time": at, "start_time": rnd.choice([at + waited, None]),
                     "job_type": rnd.choice(["QUERY", "QUERY", "LOAD", None])})
        for k in range(rnd.randrange(6)):
            periods.append({"job_id": f"j{i}", "period_start": at + timedelta(seconds=k * 20),
                            "period_slot_ms": rnd.choice([None, rnd.randrange(300_000)])})
    jobs.append({"job_id": "timeless", "job_type": "QUERY"})
    periods.append({"job_id": "timeless", "period_slot_ms": 5})
    return jobs, periods


def _chunks(rows, time, size):
    """Chunks in which up to some minutes' worth of rows come late."""
    rnd = random.Random(size)
    rows = sorted(rows, key=lambda r: r.get(time, START) + timedelta(seconds=rnd.randrange(500)))
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def _limits(frame):
    reservations = frame("reservations", [{"reservation_name": "r", "slot_capacity": 3}])
    assignments = frame("assignments", [{"reservation_name": "r", "project_id": "p", "job_type": "QUERY"}])
    return reservations, assignments


def _minutes(df):
    return sorted(tuple(r) for r in df.collect())


def _start(spark, root, frame, **trigger):
    streams = [saturation.view_stream(spark, str(root), view, max_files=1) for view in ("jobs", "jobs_timeline")]
    stream = saturation.saturation_stream(*streams, *_limits(frame), "p")
    return stream, saturation.write_minutes(stream, f"{root}/out", f"{root}/state", **trigger)


def test_stream_ends_with_the_minutes_of_the_report(spark, frame, histories, tmp_path):
    """Files come one by one, late rows among them, and the query is stopped and started again."""
    jobs, periods = histories
    wanted = performance.slot_saturation(
        frame("jobs", jobs), frame("jobs_timeline", periods), *_limits(frame), "p", END, hours=None, k=None
    )
    files = [("jobs", c) for c in _chunks(jobs, "creation_time", 150)]
    files = [f for pair in zip(files, [("jobs_timeline", c) for c in _chunks(periods, "period_start", 360)]) for f in pair]
    files += [("jobs_timeline", c) for c in _chunks(periods, "period_start", 360)[len(files) // 2 :]]
    counts = []
    for view in ("jobs", "jobs_timeline"):
        (tmp_path / view).mkdir()
    for i in range(0, len(files), 5):
        for n, (view, rows) in enumerate(files[i : i + 5]):
            frame(view, rows).coalesce(1).write.parquet(f"{tmp_path}/{view}/part{i + n:03d}")
        stream, query = _start(spark, tmp_path, frame, once=True)
        query.awaitTermination()
        counts.append(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").count())
    for view in ("jobs", "jobs_timeline"):
        saturation.end_row(spark, view, END).write.parquet(f"{tmp_path}/{view}/zzz")
    stream, query = _start(spark, tmp_path, frame, once=True)
    query.awaitTermination()
    found = _minutes(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out"))
    assert found == _minutes(wanted)
    assert counts == sorted(counts) and 0 < counts[-1] < len(found)  # given out as time went on


def test_rows_later_than_the_delay_are_dropped(spark, frame, tmp_path):
    def write(view, name, *minutes):
        time = saturation.TIMES[view]
        rows = [{"job_id": "a", time: START + timedelta(minutes=m), "period_slot_ms": 60_000, "job_type": "QUERY"}
                for m in minutes]
        frame(view, rows).coalesce(1).write.parquet(f"{tmp_path}/{view}/{name}")

    for name, minutes in (("a", (0, 1)), ("b", (60,)), ("c", (2, 55)), ("d", (200,))):
        write("jobs", name, *minutes)
        write("jobs_timeline", name, *minutes)
        stream, query = _start(spark, tmp_path, frame, once=True)
        query.awaitTermination()
    found = _minutes(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out"))
    at = [int((r[0].replace(tzinfo=timezone.utc) - START).total_seconds()) // 60 for r in found]
    assert at == [0, 1, 55, 60]  # minute 2 came an hour late; 200 is not complete


def test_state_holds_minutes_not_rows(spark, frame, tmp_path):
    at = [{"job_id": "a", "period_start": START + timedelta(milliseconds=i), "period_slot_ms": 1} for i in range(3000)]
    frame("jobs_timeline", at).write.parquet(f"{tmp_path}/jobs_timeline")
    saturation.end_row(spark, "jobs", START).write.parquet(f"{tmp_path}/jobs/a")
    _, query = _start(spark, tmp_path, frame, once=True)
    query.awaitTermination()
    rows = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert rows and max(rows) <= 2


def test_registered_stream_reads_events_kept_in_one_file(spark):
    """The test folders hold ``events.parquet`` as one file: the stream must read it and end
    with the minutes of its checking SQL."""
    import compare
    from places import SF_DIR

    import __spark_entry__ as contract

    assert Path(SF_DIR, "events.parquet").is_file()
    df = contract.queries()["slot_saturation_stream"](spark, SF_DIR)
    con = compare.connect(SF_DIR)
    names, rows = compare.spark_rows(df)
    wanted_names, wanted = compare.sql_rows(con, contract.oracle_sql()["slot_saturation_stream"])
    assert names == wanted_names
    assert rows == wanted
    assert rows
