"""Reports from day partials against the same reports over the whole history."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from slotledger.plans.partials import DayPartials
from slotledger.plans.reports import run_report
from slotledger.sources.driver_tables import AS_OF
from slotledger.sources.warehouse import Warehouse

REPORTS = {
    "forecast_monthly_costs": ({}, {"days": 3}, {"days": 7}),
    "hourly_slot_consumption": ({}, {"days": 2}),
    "common_query_errors": ({}, {"days": 5, "k": 2}),
    "frequent_tables": ({}, {"days": 1, "k": 30}),
    "unused_tables": ({}, {"days_inactive": 2}),
}
TIMES = [AS_OF, AS_OF - timedelta(hours=13, minutes=7), datetime(2024, 1, 16, tzinfo=timezone.utc),
         datetime(2024, 3, 1, 5, tzinfo=timezone.utc)]


@pytest.fixture
def history(spark, warehouse, tmp_path):
    """Day folders without the last three days, which are added later."""
    jobs = warehouse.jobs.withColumn("dt", F.to_date("creation_time"))
    late = F.col("dt") > "2024-01-27"
    jobs.where(~late).coalesce(1).write.partitionBy("dt").parquet(f"{tmp_path}/jobs")
    warehouse.table_storage.write.parquet(f"{tmp_path}/table_storage")

    def add(condition):
        part = jobs.where(late & condition).coalesce(1)
        part.write.mode("append").partitionBy("dt").parquet(f"{tmp_path}/jobs")

    wh = Warehouse.from_path(spark, str(tmp_path), by_day=("jobs",))
    return DayPartials(wh, f"{tmp_path}/jobs", f"{tmp_path}/partials"), add


def _same(partials, times=TIMES):
    for as_of in times:
        for key, variants in REPORTS.items():
            for params in variants:
                found = getattr(partials, key)(as_of=as_of, **params)
                wanted = run_report(partials.wh, key, as_of=as_of, **params)
                assert found.dtypes == wanted.dtypes
                assert found.collect() == wanted.collect(), (key, as_of, params)


def test_partials_equal_the_full_scan(history):
    partials, add = history
    _same(partials, TIMES[:1])  # nothing is folded yet
    assert len(partials.fold()) == 27
    assert partials.fold() == []
    _same(partials)
    add(F.crc32("job_id") % 2 == 0)
    partials.wh.refresh()
    _same(partials, TIMES[:2])  # the new folders are not folded
    assert [d.day for d in partials.fold()] == [28, 29, 30]
    add(F.crc32("job_id") % 2 == 1)  # late files of folded days
    partials.wh.refresh()
    _same(partials, TIMES[:2])
    assert [d.day for d in partials.fold()] == [28, 29, 30]
    _same(partials, TIMES[:2])


def test_a_long_window_reads_the_folders_at_its_ends_only(history):
    partials, add = history
    partials.fold()
    df = partials.frequent_tables(as_of=datetime(2024, 1, 27, 5, tzinfo=timezone.utc), days=180)
    rest = partials.parts("references", datetime(2024, 1, 27, 5, tzinfo=timezone.utc), 180)
    text = rest._jdf.queryExecution().executedPlan().toString()
    (scan,) = re.findall(r"FileScan parquet .*/jobs\].*", text)
    assert "NOT dt" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert df.count() > 0


def test_a_history_without_day_folders_is_refused(warehouse, tmp_path):
    with pytest.raises(ValueError, match="day folders"):
        DayPartials(warehouse, str(tmp_path), str(tmp_path))
