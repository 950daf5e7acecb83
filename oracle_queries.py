"""Checking SQL for every query of ``__spark_entry__``, for DuckDB.

Each text rebuilds the views it needs from the driver's tables as CTEs and
writes the report as plain SQL over flat rows. Transcript reports are checked
against the rows the derivation put in, not by parsing the text again.
"""

from __future__ import annotations

from slotledger import fixed_values as fv
from slotledger.sources import driver_tables as d

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _select(expressions: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(d.columns(expressions))} FROM {source}"


def _round(value: str, places: int) -> str:
    """Round half away from zero on the printed number, as Spark does."""
    exact = f"CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,14))"
    return f"CAST(round({exact}, {places}) AS DOUBLE)"


_CTES = {
    "jobs": _select(d.JOBS, "events"),
    "job_refs": " UNION ALL ".join(
        _select({"job_id": d.JOBS["job_id"], **refs}, f"events WHERE NOT ({d.NO_REFERENCES})")
        for refs in d.REFERENCES
    ),
    "job_stages": _select(
        {"job_id": d.JOBS["job_id"], **d.STAGE},
        f"(SELECT event_id, unnest(range(CAST({d.STAGES} + 1 AS BIGINT))) AS s FROM events "
        f"WHERE NOT ({d.NO_STAGES})) AS e",
    ),
    "jobs_timeline": _select(
        d.TIMELINE,
        f"(SELECT event_id, ts, unnest(range(CAST({d.PERIODS} + 1 AS BIGINT))) AS i FROM events) AS e",
    ),
    "table_storage": _select(d.TABLE_STORAGE, "part"),
    "tables": _select(d.TABLES, "part"),
    "schemata_options": _select(d.SCHEMATA_OPTIONS, "supplier"),
    "object_privileges": _select(d.OBJECT_PRIVILEGES, "customer"),
    "recommendations": _select(
        d.RECOMMENDATIONS, "supplier JOIN events ON event_id = s_suppkey"
    ),
    "reservations": _select(d.RESERVATIONS, "region"),
    "assignments": _select(d.ASSIGNMENTS, "region"),
    "dataset_access": _select(d.DATASET_ENTRY, "supplier")
    + " UNION ALL "
    + _select(
        {
            "dataset_id": d.DATASET_ENTRY["dataset_id"],
            "special_group": "'projectOwners'",
            "role": "'OWNER'",
        },
        "supplier",
    ),
    "billing_export": _select(d.BILLING_EXPORT, "lineitem JOIN part ON l_partkey = p_partkey"),
    "agent_events": _select(
        {
            "session_id": "'session_' || CAST(conv_id AS STRING)",
            "seq": "turn",
            "text": d.MESSAGE_TEXT,
            "spoken": "text",
            "conv_id": "conv_id",
            "turn": "turn",
            "role": "role",
            "text_kind": d.TEXT_KIND,
            "payload_kind": d.PAYLOAD_KIND,
            "tool": d.PAYLOAD_TOOL,
        },
        "conversations",
    ),
}


def _recent(days: int, column: str = "creation_time") -> str:
    """Later than as_of minus the days, not later than as_of."""
    return f"({column} > {AS_OF} - INTERVAL '{days} days' AND {column} <= {AS_OF})"


def _with(views: str, body: str) -> str:
    ctes = ", ".join(f"{name} AS ({_CTES[name]})" for name in views.split())
    return f"WITH {ctes} {body}"


GIB = "1073741824e0"
HOURS = "3600000e0"


def _recommendation_sql(predicate: str) -> str:
    return _with(
        "recommendations",
        f"""SELECT last_updated_time, description, target AS target_resources,
                   category AS primary_impact, additional_details
            FROM recommendations WHERE {predicate} AND state = 'ACTIVE'
            ORDER BY last_updated_time DESC, recommendation_id LIMIT 20""",
    )


#: The rule that each of the twelve kinds of derived statement was made to break.
_BROKEN = (
    "SELECT_STAR", "ORDER_BY_RAND", "ORDER_WITHOUT_LIMIT", "REGEXP", "LEADING_WILDCARD", "CROSS_JOIN",
    "COMMA_JOIN", "SINGLE_ROW_INSERT", "STRING_CAST_FILTER", "IN_SUBQUERY", "UNION_DISTINCT",
)


def _found(label: int, number: bool = False) -> str:
    """What a job's statement breaks, by its number; no pattern is tried again."""
    labels = {rule[0]: str(i) if number else rule[label] for i, rule in enumerate(fv.ANTIPATTERN_RULES, 1)}
    whens = " ".join(f"WHEN {n} THEN {_quote(labels[code])}" for n, code in enumerate(_BROKEN))
    return f"CASE CAST(substr(job_id, 5) AS BIGINT) % 12 {whens} ELSE '' END"


def _heaviest(window: str, limit: str) -> str:
    return f""", heaviest AS (
          SELECT * FROM jobs WHERE {window} AND statement_type = 'SELECT'
          QUALIFY row_number() OVER (PARTITION BY query ORDER BY total_slot_ms DESC, job_id) = 1
          {limit})
        SELECT user_email, job_id, query,
               {_round(f'total_bytes_processed / {GIB}', 2)} AS gb_processed,
               {_round(f'total_slot_ms / {HOURS}', 2)} AS slot_hours,
               coalesce(nullif({_found(3)}, ''), '{fv.NO_ANTIPATTERN}')
                 AS detected_antipatterns
        FROM heaviest"""


_UNPARTITIONED = """
    SELECT t.table_schema, t.table_name, t.total_logical_bytes
    FROM table_storage t JOIN tables x
      ON t.table_schema = x.table_schema AND t.table_name = x.table_name
    WHERE x.ddl NOT LIKE '%PARTITION BY%' AND t.total_logical_bytes > {bytes}
"""


def _unused(days: int) -> str:
    return f"""
        SELECT DISTINCT t.table_schema, t.table_name, t.total_logical_bytes
        FROM table_storage t
        WHERE t.total_logical_bytes > 0 AND NOT EXISTS (
          SELECT 1 FROM jobs j JOIN job_refs r ON j.job_id = r.job_id
          WHERE {_recent(days, 'j.creation_time')}
            AND r.table_id = t.table_name AND r.dataset_id = t.table_schema)
    """


_PHYSICAL = "total_physical_bytes + time_travel_physical_bytes + fail_safe_physical_bytes"
_LOGICAL_COST = f"""(active_logical_bytes / {GIB}) * {fv.LOGICAL_ACTIVE_PRICE}::DOUBLE
    + (long_term_logical_bytes / {GIB}) * {fv.LOGICAL_LONG_TERM_PRICE}::DOUBLE"""
_PHYSICAL_COST = f"""(active_physical_bytes / {GIB}) * {fv.PHYSICAL_ACTIVE_PRICE}::DOUBLE
    + (long_term_physical_bytes / {GIB}) * {fv.PHYSICAL_LONG_TERM_PRICE}::DOUBLE
    + ((time_travel_physical_bytes + fail_safe_physical_bytes) / {GIB})
      * {fv.PHYSICAL_ACTIVE_PRICE}::DOUBLE"""
_LOGICALLY_BILLED = """
    FROM table_storage t LEFT JOIN schemata_options s
      ON t.table_schema = s.schema_name AND s.option_name = 'storage_billing_model'
    WHERE t.total_physical_bytes > 0 AND (s.option_value = 'LOGICAL' OR s.option_value IS NULL)
"""
_DAILY = f"""
    SELECT CAST(creation_time AS DATE) AS usage_date, sum(total_slot_ms) AS slots,
           sum(total_bytes_billed) AS billed
    FROM jobs WHERE {_recent(30)} GROUP BY 1
"""


def _daily_mean(column: str, unit: int, times: int = 1) -> str:
    """Mean per day from whole numbers, so that ties round alike."""
    return _round(
        f"CAST(sum({column}) * {times} AS DOUBLE) / CAST(count({column}) * {unit} AS DOUBLE)", 2
    )


_MINUTES = f"""
    capacity AS (
      SELECT CAST(coalesce((SELECT sum(slot_capacity + coalesce(max_slots, 0)) FROM reservations
        WHERE reservation_name = (SELECT reservation_name FROM assignments
          WHERE project_id = '{{project}}' AND job_type = 'QUERY')), {fv.DEFAULT_SLOT_LIMIT}) AS BIGINT)
        AS system_slot_limit),
    usage AS (
      SELECT date_trunc('minute', period_start) AS time_bucket,
             CAST((2 * sum(period_slot_ms) + 60000) // 120000 AS BIGINT) AS avg_slots_used
      FROM jobs_timeline WHERE {{window_of_period_start}} GROUP BY 1),
    waits AS (
      SELECT date_trunc('minute', creation_time) AS time_bucket, count(job_id) AS jobs_submitted,
             CAST(sum(date_sub('millisecond', creation_time, start_time)) AS BIGINT)
               / CAST(1000 * count(*) AS DOUBLE) AS wait
      FROM jobs WHERE {{window_of_creation_time}} AND job_type = 'QUERY'
      GROUP BY 1),
    minutes AS (
      SELECT time_bucket, avg_slots_used, system_slot_limit,
             {_round('avg_slots_used / CAST(system_slot_limit AS DOUBLE) * 100', 1)}
               AS capacity_used_pct,
             jobs_submitted, {_round('wait', 2)} AS avg_wait_sec
      FROM usage LEFT JOIN waits USING (time_bucket) CROSS JOIN capacity),
    saturation AS (
      SELECT *, CASE
          WHEN avg_wait_sec > 2 AND avg_slots_used > system_slot_limit * 0.9::DOUBLE
            THEN '{fv.STATUS_CRITICAL}'
          WHEN avg_wait_sec > 2 AND avg_slots_used < system_slot_limit * 0.5::DOUBLE
            THEN '{fv.STATUS_QUEUING}'
          ELSE '{fv.STATUS_OK}' END AS health_status
      FROM minutes ORDER BY time_bucket DESC {{limit}})
"""


def _saturation(
    hours: int | None = 6, limit: str = "LIMIT 100", project: str = d.PROJECT_ID
) -> str:
    text = _MINUTES.replace("{limit}", limit).replace("{project}", project)
    for column in ("period_start", "creation_time"):
        window = f"{column} <= {AS_OF}"
        if hours is not None:
            window += f" AND {column} > {AS_OF} - INTERVAL '{hours} hours'"
        text = text.replace("{window_of_%s}" % column, window)
    return text


_SKEW = f"""
    peaks AS (SELECT job_id, period_slot_ms / 1000e0 AS slots,
                     max(period_slot_ms / 1000e0) OVER (PARTITION BY job_id) AS peak
              FROM jobs_timeline),
    tails AS (SELECT job_id, max(peak) AS peak_slots,
                     count(*) FILTER (WHERE slots < peak * 0.1::DOUBLE) / CAST(count(*) AS DOUBLE)
                       AS tail
              FROM peaks GROUP BY 1),
    ratios AS (SELECT job_id, name, write_ms_max / CAST(nullif(write_ms_avg, 0) AS DOUBLE) AS w,
                      compute_ms_max / CAST(nullif(compute_ms_avg, 0) AS DOUBLE) AS c
               FROM job_stages WHERE end_ms - start_ms > 1000),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY
                 CASE WHEN w IS NOT NULL AND c IS NOT NULL THEN greatest(w, c) END
                   DESC NULLS LAST, name DESC) AS rn FROM ratios),
    stages AS (SELECT job_id, max(w) AS w, max(c) AS c, max(CASE WHEN rn = 1 THEN name END) AS worst
               FROM ranked GROUP BY 1),
    diagnosed AS (
      SELECT job_id, peak_slots, {_round('tail * 100', 1)} AS tail_pct,
             {_round('w', 1)} AS write_skew_ratio,
             CASE WHEN tail > 0.5 AND (w > 10 OR c > 10) THEN
                 replace(replace({_quote(fv.SKEW_CONFIRMED)}, '%d', CAST(CAST(
                   {_round('greatest(w, c)', 0)} AS BIGINT) AS VARCHAR)), '%s', worst)
               WHEN tail > 0.5 THEN {_quote(fv.SKEW_SERIAL)}
               WHEN tail <= 0.5 THEN {_quote(fv.SKEW_HEALTHY)}
               ELSE 'INCONCLUSIVE' END AS diagnosis
      FROM tails LEFT JOIN stages USING (job_id))
"""
_EXPLAIN = f"""
    CASE WHEN diagnosis LIKE 'CONFIRMED%' THEN
        replace(replace({_quote(fv.EXPLAIN_CONFIRMED.replace('%s', '<user>', 1))},
          '<user>', coalesce(user_email, 'The user')), '%s', diagnosis)
      WHEN diagnosis LIKE 'SERIAL%' THEN replace({_quote(fv.EXPLAIN_SERIAL)}, '%s', diagnosis)
      WHEN diagnosis LIKE 'HEALTHY%' THEN {_quote(fv.EXPLAIN_HEALTHY)}
      ELSE replace({_quote(fv.EXPLAIN_OTHER)}, '%s', diagnosis) END
"""
_SLOW = f"""
    FROM jobs WHERE {_recent(7)} AND job_type = 'QUERY' AND statement_type = 'SELECT'
      AND error_reason IS NULL
"""


def _scan_sql(limited: bool = False) -> str:
    def _count(source: str, k: int) -> str:
        counted = f"least(count(*), {k})" if limited else "count(*)"
        return f"(SELECT {counted} FROM ({source}))"

    number = f"(SELECT {_daily_mean('slots', fv.MS_PER_HOUR, 30)} FROM ({_DAILY}))"
    checks = [
        (1, "cost", "forecast", f"CAST({number} AS VARCHAR)", fv.FINDING_FORECAST),
        (
            2,
            "cost",
            "time_travel",
            _count("SELECT 1 FROM table_storage WHERE time_travel_physical_bytes > 0", 20),
            fv.FINDING_TIME_TRAVEL,
        ),
        (3, "cost", "unused_tables", _count(_unused(30), 50), fv.FINDING_UNUSED),
        (
            4,
            "cost",
            "top_query",
            f"(SELECT max(total_slot_ms) // 3600000 FROM jobs WHERE {_recent(30)})",
            fv.FINDING_TOP_QUERY,
        ),
        (5, "cost", "storage_model", _count("SELECT 1 " + _LOGICALLY_BILLED, 20), fv.FINDING_STORAGE),
        (
            6,
            "security",
            "public_datasets",
            """(SELECT count(*) FROM dataset_access
                WHERE special_group IN ('allUsers', 'allAuthenticatedUsers'))""",
            fv.FINDING_PUBLIC,
        ),
        (
            7,
            "security",
            "iam_recommendations",
            _count(
                f"""SELECT 1 FROM recommendations WHERE state = 'ACTIVE'
                    AND recommender = '{fv.IAM_RECOMMENDER}'""",
                20,
            ),
            fv.FINDING_IAM,
        ),
        (
            8,
            "performance",
            "top_error",
            f"""(SELECT CASE error_reason WHEN 'notFound' THEN 'Not Found' ELSE error_reason END
                 FROM jobs WHERE {_recent(30)} AND error_reason IS NOT NULL
                 GROUP BY error_reason ORDER BY count(*) DESC, error_reason LIMIT 1)""",
            fv.FINDING_ERROR,
        ),
        (
            9,
            "performance",
            "slot_health",
            """(SELECT nullif(health_status, 'OK') FROM saturation
                ORDER BY time_bucket DESC LIMIT 1)""",
            fv.FINDING_SLOT_HEALTH,
        ),
        (10, "performance", "slow_queries", _count("SELECT 1 " + _SLOW, 10), fv.FINDING_SLOW),
        (
            11,
            "performance",
            "unpartitioned",
            _count(_UNPARTITIONED.format(bytes=0), 20),
            fv.FINDING_UNPARTITIONED,
        ),
        (
            12,
            "performance",
            "partitioning",
            _count(
                f"""SELECT 1 FROM recommendations WHERE state = 'ACTIVE'
                    AND recommender = '{fv.PARTITION_RECOMMENDER}'""",
                20,
            ),
            fv.FINDING_PARTITIONING,
        ),
    ]
    rows = " UNION ALL ".join(
        f"""SELECT CAST({seq} AS INTEGER) AS seq, '{area}' AS area, '{metric}' AS metric,
                   CAST({value} AS VARCHAR) AS value, {_quote(text)} AS template"""
        for seq, area, metric, value, text in checks
    )
    views = (
        "jobs job_refs jobs_timeline table_storage tables schemata_options recommendations "
        "reservations assignments dataset_access"
    )
    return _with(
        views,
        f""", {_saturation()}, checks AS ({rows})
        SELECT seq, area, metric, value,
               CASE WHEN seq = 6 AND value = '0' THEN {_quote(fv.FINDING_NOT_PUBLIC)}
                    ELSE replace(template, '%s', value) END AS finding
        FROM checks WHERE value IS NOT NULL AND (value <> '0' OR seq IN (4, 6)) ORDER BY seq""",
    )


_TRIM = _quote(fv.WHITESPACE)


def _spoken(**kinds: str) -> str:
    """The spoken text, with what stays around it in some kinds of message, trimmed."""
    whens = " ".join(f"WHEN {kind.removeprefix('kind')} THEN {sql}" for kind, sql in kinds.items())
    return f"trim(CASE text_kind {whens} ELSE spoken END, {_TRIM})"


_CHAT = _spoken(
    kind3="""'![shot](data:image/png;base64,iVBOR==) ' || spoken
             || ' <img alt="x" src="data:image/gif;base64,R0lG">'""",
    kind4="spoken || '  end'",
)
_REPORT = _spoken(kind4="spoken || '  middle  end'")
_VALUES_0 = (
    """'[{"x":' || CAST(turn AS VARCHAR) || ',"y":"a, b"},{"x":' || CAST(conv_id AS VARCHAR)"""
    """ || ',"z":true}]'"""
)
_TABLE_EVENTS = """
    records AS (
      SELECT session_id, seq, tool, 0 AS record_no, spoken AS label, turn AS n
      FROM agent_events WHERE payload_kind = 0
      UNION ALL SELECT session_id, seq, tool, 1, role, conv_id FROM agent_events
      WHERE payload_kind = 0
      UNION ALL SELECT session_id, seq, tool, 0, role, conv_id FROM agent_events
      WHERE payload_kind = 3),
    titled AS (
      SELECT *, CASE tool WHEN 'find_unused_tables' THEN 'Find Unused Tables'
                  WHEN 'get_common_query_errors' THEN 'Get Common Query Errors'
                  ELSE 'Forecast Monthly Costs' END AS title FROM records)
"""


def oracle_sql() -> dict[str, str]:
    """Checking SQL by query; the ``_past`` queries are others as of an earlier time."""
    found = _reports_sql()
    # The stream ends with the same minutes as the history.
    found["slot_saturation_stream"] = found["slot_saturation_history"]
    past = "TIMESTAMP '%s'" % d.PAST_AS_OF.strftime("%Y-%m-%d %H:%M:%S")
    for key in (
        "forecast_monthly_costs", "unused_tables", "slot_saturation", "environment_scan",
    ):
        found[f"{key}_past"] = found[key].replace(AS_OF, past)
    return found


def _reports_sql() -> dict[str, str]:
    c = _with
    return {
        "expensive_queries": c(
            "jobs",
            f"""SELECT job_id, query, total_slot_ms / {HOURS} AS slot_hours FROM jobs
                WHERE {_recent(30)} ORDER BY total_slot_ms DESC, job_id LIMIT 10""",
        ),
        "time_travel_consumers": c(
            "table_storage",
            f"""SELECT table_schema AS dataset, table_name,
                       total_physical_bytes / {GIB} AS total_gb,
                       time_travel_physical_bytes / {GIB} AS time_travel_gb,
                       {_round('''CAST(time_travel_physical_bytes AS DOUBLE)
                         / nullif(total_physical_bytes, 0) * 100''', 2)} AS time_travel_pct
                FROM table_storage WHERE time_travel_physical_bytes > 0
                ORDER BY time_travel_physical_bytes DESC, table_schema, table_name LIMIT 20""",
        ),
        "forecast_monthly_costs": c(
            "jobs",
            f"""SELECT {_daily_mean('slots', fv.MS_PER_HOUR)} AS avg_daily_slot_hours,
                       {_daily_mean('billed', fv.BYTES_PER_TIB)} AS avg_daily_tb_billed,
                       {_daily_mean('slots', fv.MS_PER_HOUR, 30)} AS forecasted_monthly_slot_hours,
                       {_daily_mean('billed', fv.BYTES_PER_TIB, 30)} AS forecasted_monthly_tb_billed,
                       'Projections based on last 30 days average' AS note
                FROM ({_DAILY})""",
        ),
        "large_unpartitioned_tables": c(
            "table_storage tables",
            _UNPARTITIONED.format(bytes=0)
            + " ORDER BY total_logical_bytes DESC, t.table_schema, t.table_name LIMIT 20",
        ),
        "storage_compression_model": c(
            "table_storage schemata_options",
            f"""SELECT table_schema, table_name,
                  {_round('total_logical_bytes / CAST(total_physical_bytes AS DOUBLE)', 2)}
                    AS normal_compression_ratio,
                  {_round(f'total_logical_bytes / CAST({_PHYSICAL} AS DOUBLE)', 2)}
                    AS effective_compression_ratio,
                  {_round(_LOGICAL_COST, 2)} AS current_monthly_cost_usd,
                  {_round(_PHYSICAL_COST, 2)} AS estimated_physical_cost_usd,
                  {_round(f'(({_LOGICAL_COST}) - ({_PHYSICAL_COST}))', 2)}
                    AS potential_savings_usd,
                  {_quote(fv.PRICING_NOTE)} AS pricing_note, total_logical_bytes,
                  {_PHYSICAL} AS total_physical_bytes_all_features
                {_LOGICALLY_BILLED}
                ORDER BY potential_savings_usd DESC, table_schema, table_name LIMIT 20""",
        ),
        "unused_tables": c(
            "table_storage jobs job_refs",
            _unused(180) + " ORDER BY total_logical_bytes DESC, table_schema, table_name LIMIT 50",
        ),
        "table_permissions": c(
            "object_privileges",
            """SELECT grantee, privilege_type, object_schema, object_name FROM object_privileges
               WHERE object_type = 'TABLE' AND privilege_type = 'SELECT'
                 AND object_name = 't_7' AND object_schema = 'ds_0'""",
        ),
        "all_table_permissions": c(
            "object_privileges",
            """SELECT grantee, privilege_type, object_schema, object_name FROM object_privileges
               WHERE object_type = 'TABLE' AND privilege_type = 'SELECT'""",
        ),
        "public_datasets": c(
            "dataset_access",
            f"""SELECT dataset_id AS object_name, special_group AS grantee, role,
                       '{fv.PUBLIC_NOTE}' AS note FROM dataset_access
                WHERE special_group IN ('allUsers', 'allAuthenticatedUsers')""",
        ),
        "recent_table_users": c(
            "jobs job_refs",
            f"""SELECT DISTINCT user_email, creation_time, query
                FROM jobs JOIN job_refs USING (job_id)
                WHERE table_id = 't_1' AND dataset_id = 'ds_0'
                  AND creation_time BETWEEN {AS_OF} - INTERVAL '30 days' AND {AS_OF}
                ORDER BY creation_time DESC, user_email, query LIMIT 50""",
        ),
        "iam_recommendations": _recommendation_sql(f"recommender = '{fv.IAM_RECOMMENDER}'"),
        "partition_cluster_recommendations": _recommendation_sql(
            f"recommender = '{fv.PARTITION_RECOMMENDER}'"
        ),
        "materialized_view_recommendations": _recommendation_sql(
            f"recommender LIKE '{fv.MATERIALIZED_VIEW_PREFIX}%'"
        ),
        "common_query_errors": c(
            "jobs",
            f"""SELECT error_reason AS reason, count(*) AS error_count FROM jobs
                WHERE {_recent(30)} AND error_reason IS NOT NULL
                GROUP BY 1 ORDER BY error_count DESC, reason LIMIT 10""",
        ),
        "hourly_slot_consumption": c(
            "jobs",
            f"""SELECT CAST(extract(hour FROM creation_time) AS INTEGER) AS hour_of_day,
                       CAST(sum(total_slot_ms) AS BIGINT) / {HOURS} AS total_slot_hours
                FROM jobs WHERE {_recent(30)} GROUP BY 1 ORDER BY 2 DESC, 1""",
        ),
        "frequent_tables": c(
            "jobs job_refs",
            f"""SELECT table_id, dataset_id, count(*) AS query_count
                FROM jobs JOIN job_refs USING (job_id) WHERE {_recent(30)}
                GROUP BY 1, 2 ORDER BY query_count DESC, table_id, dataset_id LIMIT 20""",
        ),
        "slot_saturation": c(
            "jobs jobs_timeline reservations assignments",
            f", {_saturation()} SELECT * FROM saturation ORDER BY time_bucket DESC",
        ),
        "slot_saturation_history": c(
            "jobs jobs_timeline reservations assignments",
            f", {_saturation(None, '', d.SMALL_PROJECT_ID)} SELECT * FROM saturation",
        ),
        "partition_key_candidates": c(
            "jobs job_refs table_storage tables",
            f""", large AS ({_UNPARTITIONED.format(bytes=fv.LARGE_TABLE_BYTES)}
                  ORDER BY t.total_logical_bytes DESC, t.table_schema, t.table_name LIMIT 3)
                SELECT table_name, total_logical_bytes / {GIB} AS size_gb, query
                FROM jobs JOIN job_refs r USING (job_id) JOIN large l ON r.table_id = l.table_name
                WHERE {_recent(30)} AND statement_type = 'SELECT'
                QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY total_slot_ms DESC,
                  job_id, dataset_id, table_schema) <= 3""",
        ),
        "detect_antipatterns": c(
            "jobs",
            f"""SELECT job_id, {_found(0)} AS rule_codes, {_found(3)} AS findings
                FROM jobs""",
        ),
        "adhoc_antipatterns": c(
            "jobs",
            f"""SELECT statement_type, CAST({_found(0, True)} AS INTEGER) AS rule_no,
                       {_found(0)} AS rule, {_found(3)} AS finding, count(*) AS jobs
                FROM jobs WHERE {_found(0)} <> '' GROUP BY ALL""",
        ),
        "antipattern_queries": c(
            "jobs",
            _heaviest(_recent(30), "ORDER BY total_slot_ms DESC, query LIMIT 10"),
        ),
        "antipattern_history": c("jobs", _heaviest("true", "")),
        "slow_queries": c(
            "jobs",
            f"""SELECT job_id, user_email,
                       date_sub('millisecond', start_time, end_time) / 1000e0 AS duration_seconds,
                       total_slot_ms / {HOURS} AS slot_hours, left(query, 200) AS query_snippet,
                       total_bytes_processed / {GIB} AS gb_processed
                {_SLOW} ORDER BY duration_seconds DESC, job_id LIMIT 10""",
        ),
        "data_skew": c(
            "jobs jobs_timeline job_stages",
            f""", {_SKEW} SELECT d.job_id, peak_slots, tail_pct, write_skew_ratio, diagnosis,
                  {_EXPLAIN} AS explanation
                FROM diagnosed d LEFT JOIN jobs j ON d.job_id = j.job_id""",
        ),
        "job_wait": c(
            "jobs",
            """SELECT job_id, user_email, query, total_bytes_processed,
                      date_sub('millisecond', creation_time, start_time) / 1000e0 AS avg_wait_sec,
                      total_slot_ms FROM jobs""",
        ),
        "job_diagnosis": c(
            "jobs jobs_timeline job_stages",
            f""", {_SKEW} SELECT d.job_id, peak_slots, tail_pct, write_skew_ratio, diagnosis,
                  {_EXPLAIN} AS explanation, user_email, query, total_bytes_processed,
                  date_sub('millisecond', creation_time, start_time) / 1000e0 AS avg_wait_sec,
                  total_slot_ms
                FROM diagnosed d LEFT JOIN jobs j ON d.job_id = j.job_id""",
        ),
        "environment_scan": _scan_sql(),
        "environment_scan_limited": _scan_sql(limited=True),
        "adhoc_sql": c(
            "jobs job_refs table_storage",
            f"""SELECT s.table_schema, count(DISTINCT user_email) AS users,
                       count(*) AS reads, CAST(sum(total_slot_ms) AS BIGINT) AS slot_ms
                FROM jobs JOIN job_refs r USING (job_id) JOIN table_storage s
                  ON r.dataset_id = s.table_schema AND r.table_id = s.table_name
                GROUP BY 1""",
        ),
        "billing_by_service_sku": c(
            "billing_export",
            f"""SELECT service_description AS service, sku_description AS sku,
                       CAST(usage_start_time AS DATE) AS usage_date,
                       CAST(sum(CAST(cost AS DECIMAL(28,10))) AS DOUBLE) AS cost
                FROM billing_export GROUP BY 1, 2, 3""",
        ),
        "json_key_search": c(
            "agent_events",
            """SELECT session_id, seq,
                      CASE payload_kind WHEN 3 THEN role ELSE spoken END AS value
               FROM agent_events WHERE payload_kind <> 1
               QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) = 1""",
        ),
        "tool_tables": c(
            "agent_events",
            f""", {_TABLE_EVENTS} SELECT session_id, seq, 0 AS node_no, title,
                  record_no, label, n FROM titled""",
        ),
        "latest_tables": c(
            "agent_events",
            f""", {_TABLE_EVENTS}, places AS (
                  SELECT session_id, title, min(seq) AS first_seq, max(seq) AS last_seq
                  FROM titled GROUP BY 1, 2)
                SELECT session_id, first_seq, title, record_no, label, n
                FROM titled JOIN places USING (session_id, title) WHERE seq = last_seq""",
        ),
        "chart_specs": c(
            "agent_events",
            f"""SELECT session_id, seq, CASE text_kind
                  WHEN 0 THEN '{{"data":{{"values":' || {_VALUES_0}
                    || '}},"encoding":{{"color":{{"field":"c"}}}},"height":320,"mark":"bar","width":500}}'
                  ELSE '{{"data":{{"values":[{{"x":' || CAST(turn AS VARCHAR)
                    || '}}]}},"height":320,"mark":"line","width":500}}' END AS spec
                FROM agent_events WHERE text_kind IN (0, 4)""",
        ),
        "chart_data_csv": c(
            "agent_events",
            """SELECT session_id, seq, CASE text_kind
                 WHEN 0 THEN 'x,y,z' || chr(10) || CAST(turn AS VARCHAR) || ',"a, b",' || chr(10)
                   || CAST(conv_id AS VARCHAR) || ',,true' || chr(10)
                 ELSE 'x' || chr(10) || CAST(turn AS VARCHAR) || chr(10) END AS csv
               FROM agent_events WHERE text_kind IN (0, 4)""",
        ),
        "follow_ups": c(
            "agent_events",
            """, offered AS (
                 SELECT session_id, seq, 0 AS position,
                        'Show turn ' || CAST(turn AS VARCHAR) AS question
                 FROM agent_events WHERE text_kind IN (0, 1, 3)
                 UNION ALL
                 SELECT session_id, seq, 1, CASE text_kind WHEN 3 THEN 'Check chat '
                   ELSE 'Check, chat ' END || CAST(conv_id AS VARCHAR)
                 FROM agent_events WHERE text_kind IN (0, 1, 3))
               SELECT * FROM offered""",
        ),
        "clean_chat_text": c(
            "agent_events",
            f"""SELECT session_id, seq, {_CHAT} AS clean_text
                FROM agent_events""",
        ),
        "clean_report_text": c(
            "agent_events",
            f"""SELECT session_id, seq, {_REPORT} AS clean_text
                FROM agent_events""",
        ),
        "parse_tool_payload": f"""
            WITH kinds AS (SELECT 'call_' || CAST(conv_id AS VARCHAR) || '_'
                             || CAST(turn AS VARCHAR) AS call_id, conv_id, turn, role, text,
                             {d.TOOL_TEXT_KIND} AS kind FROM conversations)
            SELECT call_id, 0 AS row_no,
                   CASE WHEN kind IN (0, 1) THEN CAST(turn AS VARCHAR) END AS a,
                   CASE WHEN kind IN (0, 1) THEN text END AS b,
                   CASE kind WHEN 2 THEN CAST(turn AS VARCHAR) WHEN 4 THEN 'True' WHEN 6 THEN '1.5'
                     WHEN 7 THEN CAST(turn AS VARCHAR) || '.0' END AS info,
                   CASE WHEN kind = 3 THEN text END AS text,
                   CASE WHEN kind = 5 THEN '{fv.NO_TOOL_DATA}' END AS message,
                   CASE kind WHEN 8 THEN 'MCP Error: no ' || CAST(turn AS VARCHAR)
                     WHEN 9 THEN 'Invalid JSON response: {{broken ' || CAST(turn AS VARCHAR)
                     WHEN 10 THEN '{fv.TOOL_NOT_RECOGNISED}' END AS error
            FROM kinds
            UNION ALL
            SELECT call_id, 1, CAST(conv_id AS VARCHAR), role, NULL, NULL, NULL, NULL
            FROM kinds WHERE kind = 0""",
        "final_text": c(
            "agent_events",
            f"""SELECT session_id, CASE WHEN payload_kind = 1 THEN text
                  ELSE '{fv.NO_CHAT_TEXT}' END AS final_text
                FROM agent_events
                QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1""",
        ),
        "table_identifiers": c(
            "object_privileges",
            """SELECT 'proj.' || object_schema || '.' || object_name AS full_name,
                      object_schema AS dataset_id, object_name AS table_id,
                      count(*) AS grants
               FROM object_privileges GROUP BY 1, 2, 3""",
        ),
        "scan_summary": "SELECT string_agg(finding, ' | ' ORDER BY seq) AS summary "
        f"FROM ({_scan_sql()})",
    }
