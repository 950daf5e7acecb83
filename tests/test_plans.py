"""Plans over a stored warehouse: what is read, pushed down and shuffled."""

from __future__ import annotations

import re

import pytest

from slotledger.plans.reports import run_report
from slotledger.sources.driver_tables import AS_OF, PROJECT_ID


@pytest.fixture
def plan(spark, stored):
    def text(key, **params):
        df = run_report(stored, key, as_of=AS_OF, **params)
        return df._jdf.queryExecution().executedPlan().toString()

    return text


@pytest.fixture
def shuffled(spark, plan):
    """The plan with size-based broadcasts off, as for large tables."""

    def text(key, **params):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            return plan(key, **params)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    return text


def columns_read(plan_text, view):
    found = re.findall(rf"FileScan parquet .*/{view}\], .*ReadSchema: (struct<.*>)", plan_text)
    assert found, plan_text
    return found


@pytest.mark.parametrize("key", [
    "expensive_queries", "time_travel_consumers", "large_unpartitioned_tables",
    "storage_compression_model", "unused_tables", "iam_recommendations", "common_query_errors",
    "frequent_tables", "slow_queries"])
def test_limits_are_top_k(plan, key):
    assert "TakeOrderedAndProject" in plan(key)


@pytest.mark.parametrize("key, params", [
    ("expensive_queries", {}), ("forecast_monthly_costs", {}), ("unused_tables", {}),
    ("recent_table_users", {"table_name": "d.t"}), ("common_query_errors", {}),
    ("frequent_tables", {}), ("partition_key_candidates", {}), ("antipattern_queries", {}),
    ("slow_queries", {}), ("slot_saturation", {"project_id": PROJECT_ID})])
def test_time_windows_reach_scan_and_day_folders(plan, key, params):
    text = plan(key, **params)
    jobs = [line for line in text.splitlines() if "FileScan" in line and "/jobs" in line]
    assert jobs
    for line in jobs:
        assert re.search(r"PartitionFilters: \[.*dt#\d+ >= ", line), line
        assert re.search(r"PushedFilters: \[.*GreaterThan.*(creation_time|period_start),", line), line


def test_only_the_needed_columns_are_read(plan):
    assert columns_read(plan("forecast_monthly_costs"), "jobs") == [
        "struct<creation_time:timestamp,total_slot_ms:bigint,total_bytes_billed:bigint>"]
    assert columns_read(plan("unused_tables"), "jobs") == [
        "struct<creation_time:timestamp,"
        "referenced_tables:array<struct<dataset_id:string,table_id:string>>>"]
    assert columns_read(plan("common_query_errors"), "jobs") == [
        "struct<creation_time:timestamp,error_result:struct<reason:string>>"]
    assert columns_read(plan("data_skew"), "jobs")[0].startswith(
        "struct<job_id:string,user_email:string,creation_time:timestamp,job_stages:")
    timeline = "struct<job_id:string,period_start:timestamp,period_slot_ms:bigint>"
    assert set(columns_read(plan("data_skew"), "jobs_timeline")) == {timeline}


def test_recent_users_take_one_pass(plan):
    text = plan("recent_table_users", table_name="t")
    (schema,) = columns_read(text, "jobs")
    assert "table_id" in schema and "dataset_id" not in schema
    assert re.search(r"WindowGroupLimit .*dense_rank.* Partial", text)
    assert "Subquery" not in text


def test_tables_are_extracted_once(stored):
    from slotledger.operators import transcripts as tr

    text = tr.latest_tables(tr.tool_tables(stored.agent_events))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ArrowEvalPython", text)) == 1 and "Join" not in text


def test_scan_reads_no_sql_text(spark, stored):
    df = run_report(stored, "environment_scan", as_of=AS_OF, project_id=PROJECT_ID)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "query:string" not in text
    # Jobs are read for the digest, the references and the last six hours.
    assert len(re.findall(r"FileScan parquet .*/jobs\]", text)) == 3
    for view in ("table_storage", "tables", "schemata_options", "recommendations", "datasets"):
        assert len(re.findall(rf"FileScan parquet .*/{view}\]", text)) == 1, view


@pytest.mark.parametrize("key, params", [
    ("large_unpartitioned_tables", {}), ("storage_compression_model", {}), ("unused_tables", {}),
    ("data_skew", {}), ("partition_key_candidates", {})])
def test_large_joins_do_not_fall_back_to_broadcast(shuffled, key, params):
    text = shuffled(key, **params)
    assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.fixture
def small_partitions(spark):
    """Thresholds at which a few thousand rows count as skew."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_dataset_with_most_tables_is_split(small_partitions, frame):
    """One dataset holds most tables: its join partition is cut into several tasks."""
    from slotledger.operators.cost import storage_compression_model

    rows = [
        {"table_schema": "hot" if i % 10 else f"d{i}", "table_name": f"t{i}", **{
            name: i for name in (
                "total_logical_bytes", "active_logical_bytes", "long_term_logical_bytes",
                "total_physical_bytes", "active_physical_bytes", "long_term_physical_bytes",
                "time_travel_physical_bytes", "fail_safe_physical_bytes")}}
        for i in range(1, 4001)]
    options = [{"schema_name": n, "option_name": "storage_billing_model", "option_value": "LOGICAL"}
               for n in ("hot", "d10")]
    storage = frame("table_storage", rows).repartition(4)
    df = storage_compression_model(storage, frame("schemata_options", options), k=3)
    assert len(df.collect()) == 3
    assert re.search(r"Join(\(skew=true\)|.*isSkew=true| .*skew)", final_plan(df))


def test_a_job_with_most_periods_is_counted_before_the_shuffle(small_partitions, frame):
    """Most periods fall into one hour of one job; the periods are scanned and shuffled once."""
    from datetime import datetime, timedelta, timezone

    from slotledger.operators.skew import timeline_tail

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [
        {"job_id": "hot" if i % 10 else f"j{i}", "period_slot_ms": 10_000 if i % 4 else 1,
         "period_start": start + timedelta(milliseconds=i)}
        for i in range(12_000)]
    df = timeline_tail(frame("jobs_timeline", rows).repartition(4))
    got = {r.job_id: r for r in df.collect()}
    hot = [r["period_slot_ms"] for r in rows if r["job_id"] == "hot"]
    assert len(got) == 1201
    assert got["hot"].tail_ratio == sum(ms == 1 for ms in hot) / len(hot)
    text = final_plan(df)
    text = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    assert "ReusedExchange" in text and "SortAggregate" not in text
    assert re.search(r"partial_count\(1\)", text)


def test_group_limits_run_before_the_shuffle(plan):
    for key in ("partition_key_candidates", "antipattern_queries"):
        assert len(re.findall(r"WindowGroupLimit .* Partial", plan(key))) == 1


def test_skew_counts_periods_by_job_and_slot_use(shuffled):
    text = shuffled("data_skew")
    assert re.search(r"hashpartitioning\(job_id#\d+, period_slot_ms#\d+L", text)
    # Peaks and tails come from the counts: nothing ranks or gathers a job's periods.
    assert "Window" not in text
    below = text[text.index("Exchange hashpartitioning(job_id"):]
    assert "partial_count(1)" in below


def test_rules_run_where_the_text_is_read(plan):
    text = plan("detect_antipatterns")
    assert "Exchange" not in text and "Python" not in text


def test_python_runs_only_for_key_searches(stored):
    from slotledger.operators import transcripts as tr

    events = stored.agent_events
    for report in (tr.chart_specs, tr.chart_data_csv, tr.follow_ups, tr.clean_chat_text,
                   tr.clean_report_text, tr.final_text):
        assert "Python" not in report(events)._jdf.queryExecution().executedPlan().toString()
    text = tr.tool_tables(events)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in text and "Contains(payload" in text
