from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from slotledger.operators import transcripts as tr
from slotledger.plans.adhoc import adhoc_sql
from slotledger.schemas import VIEWS, view_schema
from slotledger.sinks import bundle_log, read_bundle, write_bundle
from slotledger.sources.chart_store import read_charts, write_charts
from slotledger.sources.transcripts import message_fragments, read_transcripts
from slotledger.sources.warehouse import Warehouse, conform


def test_derived_views_have_the_declared_columns(warehouse):
    for view in VIEWS:
        want = {f.name: f.dataType.simpleString() for f in view_schema(view).fields}
        assert dict(warehouse[view].dtypes) == want, view


def test_stored_views_hold_the_same_rows(stored, warehouse):
    for view in VIEWS:
        columns = view_schema(view).fieldNames()
        assert stored[view].select(columns).exceptAll(warehouse[view].select(columns)).count() == 0
        assert stored[view].count() == warehouse[view].count()


def test_unknown_views(spark, warehouse):
    with pytest.raises(ValueError):
        Warehouse.from_frames(spark, nonsense=warehouse.jobs)
    partial = Warehouse.from_frames(spark, jobs=warehouse.jobs)
    with pytest.raises(KeyError):
        partial.tables
    with pytest.raises(AttributeError):
        partial.nonsense


def test_conform_casts_and_orders(spark):
    raw = spark.sql("SELECT 'q' AS extra, 5 AS period_slot_ms, 'j' AS job_id, "
                    "timestamp_ntz'2024-01-01 00:00:00' AS period_start, '2024-01-01' AS dt")
    df = conform(raw, "jobs_timeline")
    assert df.dtypes == [("job_id", "string"), ("period_start", "timestamp"),
                         ("period_slot_ms", "bigint"), ("dt", "date")]
    with pytest.raises(ValueError, match="lacks columns"):
        conform(raw.drop("job_id"), "jobs_timeline")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="UTC"):
            conform(raw, "jobs_timeline")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_conform_narrows_nested_columns(spark, frame):
    raw = frame("datasets", [
        {"dataset_id": "d", "access_entries": [("allUsers", "READER"), None]},
        {"dataset_id": "e"}]).select(
            F.lit(1).alias("more"), "dataset_id",
            F.transform("access_entries", lambda e: F.struct(
                F.lit("x").alias("extra"), e["role"].alias("role"),
                e["special_group"].alias("special_group"))).alias("access_entries"))
    df = conform(raw, "datasets")
    assert df.dtypes == [("dataset_id", "string"),
                         ("access_entries", "array<struct<special_group:string,role:string>>")]
    rows = {r.dataset_id: r.access_entries for r in df.collect()}
    assert rows["e"] is None
    assert [tuple(e) for e in rows["d"]] == [("allUsers", "READER"), (None, None)]
    wide = spark.sql("SELECT 'r' AS reservation_name, 5 AS slot_capacity, "
                     "named_struct('current', 1, 'max_slots', 7) AS autoscale UNION ALL "
                     "SELECT 's', 5, NULL")
    got = {r.reservation_name: r.autoscale for r in conform(wide, "reservations").collect()}
    assert got["r"].asDict() == {"max_slots": 7} and got["s"] is None


def test_catalog_source(spark, warehouse, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS ops LOCATION '{tmp_path}/ops'")
    try:
        warehouse.tables.write.mode("overwrite").saveAsTable("ops.tables")
        wh = Warehouse.from_catalog(spark, "ops")
        assert wh.tables.count() == warehouse.tables.count()
    finally:
        spark.sql("DROP DATABASE ops CASCADE")


def test_bundle_is_logged_once_a_run(spark, warehouse, tmp_path):
    root, at = str(tmp_path / "bundle"), dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
    assert bundle_log(spark, root).count() == 0
    for n in (3, 4):  # the run is repeated
        reports = {"a": warehouse.tables.limit(n), "b": warehouse.datasets}
        write_bundle(reports, root, "run-1", {"a": {"n": n}}, at)
    write_bundle({"a": warehouse.tables.limit(5)}, root, "run-2", run_at=at + dt.timedelta(days=1))
    log = [(r.run_id, r.key, r.params, r.rows) for r in bundle_log(spark, root).orderBy("run_id", "key").collect()]
    assert log == [("run-1", "a", '{"n": 4}', 4), ("run-1", "b", "{}", warehouse.datasets.count()),
                   ("run-2", "a", "{}", 5)]
    assert read_bundle(spark, root, "a").count() == 5
    assert read_bundle(spark, root, "a", "run-1").count() == 4
    assert read_bundle(spark, root, "b").dtypes == warehouse.datasets.dtypes
    with pytest.raises(KeyError):
        read_bundle(spark, root, "c")


def test_a_failed_bundle_shows_nothing(spark, warehouse, tmp_path):
    root = str(tmp_path / "bundle")
    broken = spark.range(3).selectExpr("raise_error('broken') AS x")
    with pytest.raises(Exception, match="broken"):
        write_bundle({"a": warehouse.tables, "b": broken}, root, "run-1")
    assert bundle_log(spark, root).count() == 0
    write_bundle({"a": warehouse.tables.limit(1)}, root, "run-0")
    with pytest.raises(Exception, match="broken"):
        write_bundle({"a": warehouse.tables, "b": broken}, root, "run-0")
    assert read_bundle(spark, root, "a", "run-0").count() == 1


def _charts(df):
    return sorted(tuple(r) for r in df.collect())


def test_charts_share_files_and_keep_their_headers(spark, warehouse, tmp_path):
    charts = tr.chart_data_csv(warehouse.agent_events).repartition(3)
    path = str(tmp_path / "charts")
    write_charts(charts, path)
    assert _charts(read_charts(spark, path)) == _charts(charts)
    assert len(list((tmp_path / "charts").glob("*.csv"))) <= 3 < charts.count()
    write_charts(charts.limit(2), path, "append")
    assert read_charts(spark, path).count() == charts.count() + 2
    write_charts(charts.limit(1), path)
    assert read_charts(spark, path).count() == 1
    assert len(list((tmp_path / "charts").iterdir())) == 3  # one file, its index, the manifest


def test_a_failed_chart_task_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "charts")
    good = spark.createDataFrame([("a", 1, "x\n1\n")], "session_id string, seq long, csv string")
    write_charts(good, path)
    bad = spark.range(8, numPartitions=4).selectExpr(
        "'s' AS session_id", "id AS seq", "if(id = 6, raise_error('broken'), 'x\n2\n') AS csv"
    )
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            write_charts(bad, path, mode)
        assert _charts(read_charts(spark, path)) == [("a", 1, "x\n1\n")]


def test_odd_charts(spark, tmp_path):
    rows = [("s é", 2, "a,é\n1,\"x\ny\"\n"), ("s é", 2, ""), (None, None, "z\n"), ("t", 1, None)]
    charts = spark.createDataFrame(rows, "session_id string, seq long, csv string")
    write_charts(charts, str(tmp_path / "c"))
    back = sorted((tuple(r) for r in read_charts(spark, str(tmp_path / "c")).collect()), key=repr)
    assert back == sorted([*rows[:3], ("t", 1, "")], key=repr)
    write_charts(charts.limit(0), str(tmp_path / "none"))
    assert read_charts(spark, str(tmp_path / "none")).count() == 0


def test_read_transcripts(spark, tmp_path):
    messages = [{"content": {"parts": [{"text": "hi\nthere"}]}}, {"other": [1]}]
    (tmp_path / "one.json").write_text(json.dumps(messages))
    (tmp_path / "two.json").write_text(json.dumps(messages[:1], indent=2))
    (tmp_path / "bad.json").write_text("nothing")
    rows = read_transcripts(spark, str(tmp_path)).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.seq, r.text) for r in rows] == [
        ("bad", 0, None), ("one", 0, "hi\nthere"), ("one", 1, None), ("two", 0, "hi\nthere")]
    assert rows[0].payload is None
    assert json.loads(rows[1].payload) == messages[0]


def _expected(text):
    """Payloads of a file by Python's parser; one null row for a file that is no list."""
    if not text:
        return []
    try:
        found = json.loads(text)
    except ValueError:
        return [None]
    return found if isinstance(found, list) else [None]


def test_transcripts_are_read_in_ranges(spark, tmp_path):
    """Ranges of a few bytes cut files at every kind of place."""
    rnd = random.Random(7)

    def value(depth):
        kind = rnd.randrange(7 if depth else 3)
        if kind < 3:
            return rnd.choice(["", 'q"uote', "br}ace{", "back\\slash\\", '\\"', "], [", "é\n😀", ",", 5, -1.5, True])
        if kind < 5:
            return [value(depth - 1) for _ in range(rnd.randrange(4))]
        return {rnd.choice(["a", "b}", 'c"']): value(depth - 1) for _ in range(rnd.randrange(4))}

    texts = {"empty": "[]", "blank": " [ ] \n", "nothing": "", "word": "x", "object": '{"a": [1, 2]}',
             "cut": '[{"a": 1}, {"b', "more": '[{"a": 1}] {"b": 2}', "two": '[{"a": 1}][{"b": 1}]'}
    for i in range(12):
        messages = [{"content": {"parts": [{"text": value(0)}, value(3)]}, "x": value(3)} for _ in range(i)]
        texts[f"m{i}"] = json.dumps(messages, ensure_ascii=i % 2 == 0, indent=[None, 2][i % 3 == 0])
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("37", "64", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = {}
            for r in read_transcripts(spark, str(tmp_path)).orderBy("session_id", "seq").collect():
                found.setdefault(r.session_id, []).append((r.seq, r.payload and json.loads(r.payload), r.text))
            for name, text in texts.items():
                wanted = _expected(text)
                assert [p for _, p, _ in found.get(name, [])] == wanted, (name, size)
                assert [s for s, _, _ in found.get(name, [])] == list(range(len(wanted)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_long_list_is_read_by_several_tasks(spark, tmp_path):
    message = json.dumps({"content": {"parts": [{"text": "t" * 500}]}})
    (tmp_path / "big.json").write_text("[" + ", ".join([message] * 20_000) + "]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert message_fragments(spark, str(tmp_path)).rdd.getNumPartitions() >= 4
        rows = read_transcripts(spark, str(tmp_path))
        assert rows.agg(F.count("text"), F.min("seq"), F.max("seq"), F.count_distinct("seq")).first() == (
            20_000, 0, 19_999, 20_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_messages_keep_their_neighbours(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {broken}, {"b": 2}]')
    rows = read_transcripts(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.payload for r in rows] == ['{"a":1}', None, '{"b":2}']


def test_one_response_a_line(spark, tmp_path):
    lines = [json.dumps([{"content": {"parts": [{"text": f"t{i}"}]}}, {"n": i}]) for i in range(5)]
    (tmp_path / "a.jsonl").write_text("\n".join([*lines[:2], "", "broken", *lines[2:]]) + "\n")
    rows = read_transcripts(spark, str(tmp_path), lines=True).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.seq, r.text) for r in rows if r.text] == [
        (f"a#{n}", 0, f"t{i}") for i, n in enumerate((1, 2, 5, 6, 7))]
    assert [(r.session_id, r.payload) for r in rows if r.payload is None] == [("a#4", None)]


def test_equal_file_names_are_different_sessions(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s1.json").write_text(json.dumps([{"content": {"parts": [{"text": folder}]}}]))
    rows = read_transcripts(spark, str(tmp_path)).collect()
    assert sorted((r.session_id, r.seq, r.text) for r in rows) == [("a/s1", 0, "a"), ("b/s1", 0, "b")]


def test_adhoc_sql_with_parameters(warehouse):
    df = adhoc_sql(warehouse, "SELECT count(*) AS n FROM jobs WHERE job_type = :t", {"t": "LOAD"})
    assert df.first().n == warehouse.jobs.where(F.col("job_type") == "LOAD").count()
