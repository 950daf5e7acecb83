"""Declared schema of every input view.

The reports read these columns and no others; a source may hold more. Views
partitioned by day may carry the extra column ``dt`` (see
``functions.clock.since``).
"""

from __future__ import annotations

from pyspark.sql import types as T

_DDL = {
    "jobs": """
        job_id string, user_email string, query string, job_type string,
        statement_type string, creation_time timestamp, start_time timestamp,
        end_time timestamp, total_slot_ms bigint, total_bytes_processed bigint,
        total_bytes_billed bigint,
        error_result struct<reason:string,message:string>,
        referenced_tables array<struct<project_id:string,dataset_id:string,table_id:string>>,
        job_stages array<struct<name:string,start_ms:bigint,end_ms:bigint,
          write_ms_avg:bigint,write_ms_max:bigint,
          compute_ms_avg:bigint,compute_ms_max:bigint>>
    """,
    "jobs_timeline": "job_id string, period_start timestamp, period_slot_ms bigint",
    "table_storage": """
        table_schema string, table_name string, total_logical_bytes bigint,
        active_logical_bytes bigint, long_term_logical_bytes bigint,
        total_physical_bytes bigint, active_physical_bytes bigint,
        long_term_physical_bytes bigint, time_travel_physical_bytes bigint,
        fail_safe_physical_bytes bigint
    """,
    "tables": "table_schema string, table_name string, ddl string",
    "schemata_options": "schema_name string, option_name string, option_value string",
    "object_privileges": """
        object_type string, object_schema string, object_name string,
        grantee string, privilege_type string
    """,
    "recommendations": """
        recommendation_id string, recommender string, state string,
        last_updated_time timestamp, description string,
        target_resources array<string>, primary_impact struct<category:string>,
        additional_details string
    """,
    "reservations": """
        reservation_name string, slot_capacity bigint,
        autoscale struct<max_slots:bigint>
    """,
    "assignments": "reservation_name string, project_id string, job_type string",
    "datasets": "dataset_id string, access_entries array<struct<special_group:string,role:string>>",
    "billing_export": """
        cost double, usage_start_time timestamp,
        service struct<description:string>, sku struct<description:string>
    """,
    "agent_events": "session_id string, seq bigint, payload string, text string",
    "tool_payloads": "call_id string, payload string",
}

VIEWS = tuple(_DDL)


def view_schema(name: str) -> T.StructType:
    """Declared schema of a view (needs an active session)."""
    return T.StructType.fromDDL(" ".join(_DDL[name].split()))
