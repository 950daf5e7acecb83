"""A warehouse derived from the TPC-H-like tables of the test data.

Each view is a projection of whole tables: nothing is sampled, and every view
grows with its table. Keys repeat unevenly on purpose: a third of the jobs read
one table and share four SQL texts, and a third of all timeline rows belong to
one long-lived job.

The expressions are plain SQL, so that the checking database can rebuild the
same rows; nested columns are folded in Spark.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger import fixed_values as fv
from slotledger.sources.warehouse import Warehouse

PAST_AS_OF = datetime(2024, 1, 16, 0, 10, tzinfo=timezone.utc)
AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
PROJECT_ID = "proj"
#: A project whose few slots are often used up.
SMALL_PROJECT_ID = "small"

# Read schemas: zone-less time stamps are read as UTC instants.
_READ = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
    "supplier": "s_suppkey bigint, s_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "region": "r_regionkey int, r_name string",
    "lineitem": "l_partkey bigint, l_extendedprice double, l_discount double, "
    "l_shipdate timestamp",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _string(number: str) -> str:
    return f"CAST({number} AS STRING)"


def _table_name(number: str) -> str:
    return f"'t_' || {_string(number)}"


def _dataset_name(number: str) -> str:
    """Twenty tables per dataset."""
    return f"'ds_' || {_string(f'CAST((({number}) - ({number}) % 20) / 20 AS BIGINT)')}"


def _later(millis: str) -> str:
    return f"ts + INTERVAL '0.001 seconds' * ({millis})"


# --- flat expressions, name -> SQL, over the columns of one source table -------
JOBS = {
    "job_id": f"'job_' || {_string('event_id')}",
    "user_email": f"'user' || {_string('user_id')} || '@example.com'",
    "query": f"""
        CASE event_id % 12
          WHEN 0 THEN 'SELECT * FROM ds_1.t_1'
          WHEN 1 THEN 'SELECT a FROM ds_1.t_1 ORDER BY RAND() LIMIT 5'
          WHEN 2 THEN 'SELECT a FROM ds_1.t_1 ORDER BY a'
          WHEN 3 THEN 'SELECT a FROM ds_1.t_1 WHERE REGEXP_CONTAINS(a, r"x")'
          WHEN 4 THEN 'SELECT a FROM ds_1.t_1 WHERE a LIKE "%tail"'
          WHEN 5 THEN 'SELECT a FROM ds_1.t_1 CROSS JOIN ds_2.t_2'
          WHEN 6 THEN 'select a from ds_1.t_1 , ds_2.t_2'
          WHEN 7 THEN 'INSERT INTO ds_1.t_1 (a) VALUES (1)'
          WHEN 8 THEN 'SELECT a FROM ds_1.t_1 WHERE CAST(a AS STRING) = "1"'
          WHEN 9 THEN 'SELECT a FROM ds_1.t_1 WHERE a IN (SELECT b FROM ds_2.t_2)'
          WHEN 10 THEN 'SELECT a FROM ds_1.t_1 UNION DISTINCT SELECT b FROM ds_2.t_2'
          ELSE 'SELECT a FROM ds_1.t_1 UNION ALL SELECT b FROM ds_2.t_2'
        END || ' /* v' || {_string('''
          CASE WHEN event_id % 3 = 1 THEN 0
               ELSE CAST((event_id - event_id % 24) / 24 AS BIGINT) END''')} || ' */'
    """,
    "job_type": "CASE WHEN event_id % 10 = 9 THEN 'LOAD' ELSE 'QUERY' END",
    "statement_type": """
        CASE WHEN event_id % 10 = 9 THEN NULL
             WHEN event_id % 5 = 3 THEN 'INSERT' ELSE 'SELECT' END
    """,
    "creation_time": "ts",
    "start_time": _later("(event_id * 37) % 5000"),
    "end_time": _later("(event_id * 37) % 5000 + (event_id * 7919) % 600000"),
    "total_slot_ms": "(event_id * 104729) % 360000000",
    "total_bytes_processed": "(event_id * 1299709) % 1099511627776",
    "total_bytes_billed": "(event_id * 1299709) % 1099511627776"
    " - ((event_id * 1299709) % 1099511627776) % 1048576",
    "error_reason": """
        CASE WHEN event_type = 'error' THEN
          CASE WHEN event_id % 7 < 4 THEN 'notFound'
               WHEN event_id % 7 < 6 THEN 'invalidQuery' ELSE 'accessDenied' END
        END
    """,
}
# Two table references per job, and none at all for some jobs.
REFERENCED = (
    "CASE WHEN event_id % 3 = 0 THEN 1 ELSE CAST((event_id - event_id % 7) / 7 AS BIGINT) END",
    "(event_id * 17 + 3) % 150",
)
REFERENCES = [
    {"dataset_id": _dataset_name(n), "table_id": _table_name(n)} for n in REFERENCED
]
NO_REFERENCES = "event_id % 50 = 49"
# Stage s of a job, s = 0 .. STAGES; some jobs have no stage list.
STAGES = "event_id % 4"
NO_STAGES = "event_id % 6 = 5"
STAGE = {
    "name": f"'S' || {_string('s')}",
    "start_ms": "CAST(0 AS BIGINT)",
    "end_ms": "(event_id * 613 + s * 1009) % 5000",
    "write_ms_avg": "CASE WHEN (event_id + s) % 11 = 0 THEN 0"
    " ELSE 500 + (event_id * 31 + s) % 1500 END",
    "write_ms_max": "(event_id * 7919 + s * 37) % 20011",
    "compute_ms_avg": "CASE WHEN (event_id + s) % 13 = 0 THEN 0"
    " ELSE 500 + (event_id * 37 + s) % 1500 END",
    "compute_ms_max": "(event_id * 6101 + s * 41) % 20021",
}
# Period i of a job's timeline, i = 0 .. PERIODS.
PERIODS = "event_id % 8"
TIMELINE = {
    "job_id": f"'job_' || {_string('CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END')}",
    "period_start": _later("1000 * i"),
    "period_slot_ms": """
        CASE WHEN event_id % 4 = 0 AND i > 0 THEN (event_id * 31 + i * 17) % 9000
             WHEN event_id % 4 = 0 THEN 200000 + event_id % 1000
             ELSE 50000 + (event_id * 7919 + i * 104729) % 150000 END
    """,
}
_SIZES = {
    "active_logical_bytes": "(p_partkey * 982451653) % 1099511627776"
    " + CASE WHEN p_partkey < 150 THEN 2199023255552 ELSE 0 END",
    "long_term_logical_bytes": "(p_partkey * 961748941) % 549755813888",
    "active_physical_bytes": "(p_partkey * 472882027) % 274877906944",
    "long_term_physical_bytes": "(p_partkey * 32452843) % 137438953472",
    "time_travel_physical_bytes": "CASE WHEN p_partkey % 4 = 0 THEN 0"
    " ELSE (p_partkey * 49979687) % 68719476736 END",
    "fail_safe_physical_bytes": "(p_partkey * 86028121) % 34359738368",
}


def _total(*parts: str) -> str:
    return " + ".join(f"({_SIZES[part]})" for part in parts)


TABLE_STORAGE = {
    "table_schema": _dataset_name("p_partkey"),
    "table_name": _table_name("p_partkey"),
    "total_logical_bytes": _total("active_logical_bytes", "long_term_logical_bytes"),
    "active_logical_bytes": _SIZES["active_logical_bytes"],
    "long_term_logical_bytes": _SIZES["long_term_logical_bytes"],
    "total_physical_bytes": _total(
        "active_physical_bytes", "long_term_physical_bytes", "time_travel_physical_bytes"
    ),
    "active_physical_bytes": _SIZES["active_physical_bytes"],
    "long_term_physical_bytes": _SIZES["long_term_physical_bytes"],
    "time_travel_physical_bytes": _SIZES["time_travel_physical_bytes"],
    "fail_safe_physical_bytes": _SIZES["fail_safe_physical_bytes"],
}
TABLES = {
    "table_schema": _dataset_name("p_partkey"),
    "table_name": _table_name("p_partkey"),
    "ddl": """
        CASE WHEN p_size % 10 = 0 THEN NULL
             WHEN p_size % 3 = 0 THEN 'CREATE TABLE t (d DATE) PARTITION BY d'
             ELSE 'CREATE TABLE t (d DATE)' END
    """,
}
SCHEMATA_OPTIONS = {
    "schema_name": f"'ds_' || {_string('s_suppkey')}",
    "option_name": "CASE WHEN s_suppkey % 3 = 2 THEN 'default_table_expiration_days'"
    " ELSE 'storage_billing_model' END",
    "option_value": "CASE s_suppkey % 3 WHEN 0 THEN 'PHYSICAL' WHEN 1 THEN 'LOGICAL'"
    " ELSE '30' END",
}
OBJECT_PRIVILEGES = {
    "object_type": "CASE WHEN c_custkey % 9 = 0 THEN 'VIEW' ELSE 'TABLE' END",
    "object_schema": _dataset_name("c_custkey % 40"),
    "object_name": _table_name("c_custkey % 40"),
    "grantee": "'user:' || c_name",
    "privilege_type": "CASE WHEN c_nationkey % 3 = 0 THEN 'UPDATE' ELSE 'SELECT' END",
}
# Over supplier joined with events on event_id = s_suppkey.
RECOMMENDATIONS = {
    "recommendation_id": f"'rec_' || {_string('s_suppkey')}",
    "recommender": f"""
        CASE s_suppkey % 4 WHEN 0 THEN '{fv.IAM_RECOMMENDER}'
          WHEN 1 THEN '{fv.PARTITION_RECOMMENDER}'
          WHEN 2 THEN '{fv.MATERIALIZED_VIEW_PREFIX}.Recommender'
          ELSE 'other.Recommender' END
    """,
    "state": "CASE WHEN s_suppkey % 5 = 4 THEN 'DISMISSED' ELSE 'ACTIVE' END",
    "last_updated_time": "ts",
    "description": "'advice for ' || s_name",
    "target": f"'target_' || {_string('s_suppkey')}",
    "category": "CASE WHEN s_suppkey % 2 = 0 THEN 'SECURITY' ELSE 'COST' END",
    "additional_details": f"'{{\"supplier\":' || {_string('s_suppkey')} || '}}'",
}
RESERVATIONS = {
    "reservation_name": "r_name",
    "slot_capacity": "CAST(CASE WHEN r_regionkey = 4 THEN 12 ELSE 100 * (r_regionkey + 1) END AS BIGINT)",
    "max_slots": "CASE WHEN r_regionkey IN (0, 2) THEN CAST(50 AS BIGINT) END",
}
ASSIGNMENTS = {
    "reservation_name": "r_name",
    "project_id": f"CASE WHEN r_regionkey = 4 THEN '{SMALL_PROJECT_ID}' ELSE '{PROJECT_ID}' END",
    "job_type": "CASE WHEN r_regionkey IN (0, 4) THEN 'QUERY' ELSE 'PIPELINE' END",
}
# Each dataset has this entry and one for its owners.
DATASET_ENTRY = {
    "dataset_id": f"'ds_' || {_string('s_suppkey')}",
    "special_group": "CASE s_suppkey % 5 WHEN 0 THEN 'allUsers'"
    " WHEN 1 THEN 'allAuthenticatedUsers' WHEN 2 THEN 'projectReaders' END",
    "role": "CASE WHEN s_suppkey % 2 = 0 THEN 'READER' ELSE 'WRITER' END",
}
# Over lineitem joined with part on l_partkey = p_partkey.
BILLING_EXPORT = {
    "cost": "l_extendedprice * (1 - l_discount)",
    "usage_start_time": "l_shipdate",
    "service_description": "p_type",
    "sku_description": "p_brand",
}

_TURN, _CONV = _string("turn"), _string("conv_id")
# Message text: the spoken text with one of six sets of tags around it.
TEXT_KIND = "(conv_id * 3 + turn) % 6"
MESSAGE_TEXT = f"""
    CASE {TEXT_KIND}
      WHEN 0 THEN '[VEGA]```json{{"mark":"bar","color":{{"field":"c"}},"data":{{"values":[{{"x":'
        || {_TURN} || ',"y":"a, b"}},{{"x":' || {_CONV} || ',"z":true}}]}}}}```[/VEGA] ' || text
        || ' [FOLLOW_UP]["Show turn ' || {_TURN} || '", "Check, chat ' || {_CONV}
        || '"][/FOLLOW_UP]'
      WHEN 1 THEN text || ' [DASHBOARD_GENERATED][FOLLOW_UP][''Show turn ' || {_TURN}
        || ''', ''Check, chat ' || {_CONV} || ''',][/FOLLOW_UP]'
      WHEN 2 THEN '[DASHBOARD_IMAGE]data:image/png;base64,AAAA[/DASHBOARD_IMAGE] ' || text
        || ' [FOLLOW_UP]Show turn ' || {_TURN}
      WHEN 3 THEN '![shot](data:image/png;base64,iVBOR==) ' || text
        || ' <img alt="x" src="data:image/gif;base64,R0lG"> [FOLLOW_UP][Show turn ' || {_TURN}
        || ', Check chat ' || {_CONV} || '][/FOLLOW_UP]'
      WHEN 4 THEN text || ' [VEGA]{{"mark":"line","data":{{"values":[{{"x":' || {_TURN}
        || '}}]}}}}[/VEGA] middle [VEGA]not a chart[/VEGA] end'
      ELSE text
    END
"""
# Message payload: a tool response of one of three shapes, or a text message.
PAYLOAD_KIND = "(conv_id + turn) % 4"
PAYLOAD_TOOL = """
    CASE conv_id % 3 WHEN 0 THEN 'find_unused_tables' WHEN 1 THEN 'get_common_query_errors'
      ELSE 'forecast_monthly_costs' END
"""
# Tool payload: a list, an object, a number, plain text, a flag or nothing.
TOOL_TEXT_KIND = "(conv_id + 2 * turn) % 11"


def _message_payload() -> str:
    record = "named_struct('label', text, 'n', turn)"
    other = "named_struct('label', role, 'n', conv_id)"
    nested = f"""named_struct('name', {PAYLOAD_TOOL}, 'response', named_struct(
        'name', {PAYLOAD_TOOL}, 'content', array({record}, {other})))"""
    foreign = f"""named_struct('name', 'another_tool', 'response', named_struct(
        'content', array({record})))"""
    flat = f"named_struct('name', {PAYLOAD_TOOL}, 'content', array({other}))"

    def message(response: str) -> str:
        part = f"named_struct('{fv.TOOL_RESPONSE_KEY}', {response})"
        return f"to_json(named_struct('content', named_struct('parts', array({part}))))"

    spoken = f"""to_json(named_struct('content', named_struct(
        'parts', array(named_struct('text', {MESSAGE_TEXT})), 'role', role)))"""
    return f"""
        CASE {PAYLOAD_KIND} WHEN 0 THEN {message(nested)} WHEN 1 THEN {spoken}
          WHEN 2 THEN {message(foreign)} ELSE {message(flat)} END
    """


def _tool_payload() -> str:
    record = "named_struct('a', turn, 'b', text)"
    body = f"""
        CASE {TOOL_TEXT_KIND}
          WHEN 0 THEN to_json(array({record}, named_struct('a', conv_id, 'b', role)))
          WHEN 1 THEN to_json({record}) WHEN 2 THEN {_TURN} WHEN 3 THEN text
          WHEN 4 THEN 'true' WHEN 6 THEN '1.50' WHEN 7 THEN {_TURN} || '.0' ELSE '[]' END
    """
    good = f"""to_json(named_struct('result', named_struct('content', array(
        named_struct('type', 'text', 'text', {body}),
        named_struct('type', 'image', 'text', 'skipped')))))"""
    failed = f"to_json(named_struct('error', named_struct('message', 'no ' || {_TURN})))"
    return f"""CASE {TOOL_TEXT_KIND} WHEN 8 THEN {failed} WHEN 9 THEN '{{broken ' || {_TURN}
        WHEN 10 THEN '{{}}' ELSE {good} END"""


def columns(expressions: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in expressions.items()]


def _struct(expressions: dict[str, str]) -> str:
    return f"named_struct({', '.join(f'{name!r}, {sql}' for name, sql in expressions.items())})"


class _Tables:
    """The source tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, read: dict[str, DataFrame] | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self._read: dict[str, DataFrame] = dict(read or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            reader = self.spark.read.schema(_READ[name])
            self._read[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]


def _jobs(t: _Tables) -> DataFrame:
    flat = {name: sql for name, sql in JOBS.items() if name != "error_reason"}
    reason = JOBS["error_reason"]
    error = f"CASE WHEN {reason} IS NOT NULL THEN named_struct('reason', {reason}, 'message', '') END"
    references = ", ".join(_struct({"project_id": f"'{PROJECT_ID}'", **r}) for r in REFERENCES)
    return t["events"].selectExpr(
        *columns(flat),
        f"{error} AS error_result",
        f"CASE WHEN NOT ({NO_REFERENCES}) THEN array({references}) END AS referenced_tables",
        f"CASE WHEN NOT ({NO_STAGES}) THEN transform(sequence(0, {STAGES}), s -> {_struct(STAGE)})"
        " END AS job_stages",
    )


def _jobs_timeline(t: _Tables) -> DataFrame:
    periods = F.explode(F.sequence(F.lit(0), F.expr(PERIODS)))
    return t["events"].select("event_id", "ts", periods.alias("i")).selectExpr(*columns(TIMELINE))


def _recommendations(t: _Tables) -> DataFrame:
    events = t["events"].select("event_id", "ts")
    joined = t["supplier"].join(events, F.col("event_id") == F.col("s_suppkey"))
    flat = {k: v for k, v in RECOMMENDATIONS.items() if k not in ("target", "category")}
    return joined.selectExpr(
        *columns(flat),
        f"array({RECOMMENDATIONS['target']}) AS target_resources",
        f"named_struct('category', {RECOMMENDATIONS['category']}) AS primary_impact",
    )


def _reservations(t: _Tables) -> DataFrame:
    return t["region"].selectExpr(
        f"{RESERVATIONS['reservation_name']} AS reservation_name",
        f"{RESERVATIONS['slot_capacity']} AS slot_capacity",
        f"named_struct('max_slots', {RESERVATIONS['max_slots']}) AS autoscale",
    )


def _datasets(t: _Tables) -> DataFrame:
    entry = {k: v for k, v in DATASET_ENTRY.items() if k != "dataset_id"}
    owners = _struct({"special_group": "'projectOwners'", "role": "'OWNER'"})
    return t["supplier"].selectExpr(
        f"{DATASET_ENTRY['dataset_id']} AS dataset_id",
        f"array({_struct(entry)}, {owners}) AS access_entries",
    )


def _billing_export(t: _Tables) -> DataFrame:
    part = t["part"].select("p_partkey", "p_type", "p_brand")
    joined = t["lineitem"].join(part, F.col("l_partkey") == F.col("p_partkey"))
    b = BILLING_EXPORT
    return joined.selectExpr(
        f"{b['cost']} AS cost",
        f"{b['usage_start_time']} AS usage_start_time",
        f"named_struct('description', {b['service_description']}) AS service",
        f"named_struct('description', {b['sku_description']}) AS sku",
    )


def _agent_events(t: _Tables) -> DataFrame:
    return t["conversations"].selectExpr(
        f"'session_' || {_CONV} AS session_id",
        "turn AS seq",
        f"{_message_payload()} AS payload",
        f"{MESSAGE_TEXT} AS text",
    )


def _tool_payloads(t: _Tables) -> DataFrame:
    return t["conversations"].selectExpr(
        f"'call_' || {_CONV} || '_' || {_TURN} AS call_id", f"{_tool_payload()} AS payload"
    )


def driver_streams(spark: SparkSession, sf_dir: str, ended: str) -> tuple[DataFrame, DataFrame]:
    """``jobs`` and ``jobs_timeline`` as streams of the whole ``events``.

    The last event comes from the folder ``ended``: one at the end of ``write_end``'s time.
    ``events.parquet`` may be one file or a folder: a stream of a plain path takes it as the
    base of partitions, which must be a folder, so the path is named by a glob of itself.
    """
    reader = spark.readStream.schema(_READ["events"])
    events = reader.parquet(f"{sf_dir}/{{events.parquet}}").unionByName(reader.parquet(ended))
    t = _Tables(spark, sf_dir, {"events": events})
    return _jobs(t), _jobs_timeline(t)


def write_end(spark: SparkSession, path: str, at: datetime) -> None:
    """An event at ``at``: it ends the streams, as all other events are older."""
    end = spark.range(1).select(
        F.col("id").alias("event_id"), F.lit(at).alias("ts"), F.lit(0).cast("bigint").alias("user_id"),
        F.lit("end").alias("event_type"),
    )
    end.write.parquet(path)


def driver_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The derived warehouse of one test-data folder."""
    t = _Tables(spark, sf_dir)

    def project(table: str, expressions: dict[str, str]):
        return lambda: t[table].selectExpr(*columns(expressions))

    return Warehouse(
        spark,
        {
            "jobs": lambda: _jobs(t),
            "jobs_timeline": lambda: _jobs_timeline(t),
            "table_storage": project("part", TABLE_STORAGE),
            "tables": project("part", TABLES),
            "schemata_options": project("supplier", SCHEMATA_OPTIONS),
            "object_privileges": project("customer", OBJECT_PRIVILEGES),
            "recommendations": lambda: _recommendations(t),
            "reservations": lambda: _reservations(t),
            "assignments": project("region", ASSIGNMENTS),
            "datasets": lambda: _datasets(t),
            "billing_export": lambda: _billing_export(t),
            "agent_events": lambda: _agent_events(t),
            "tool_payloads": lambda: _tool_payloads(t),
        },
    )
