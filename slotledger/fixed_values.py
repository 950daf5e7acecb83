"""Values that the reports must reproduce literally.

Fixed values: everything in this module is part of a report's output contract
(texts, thresholds, prices, names, patterns). They are listed here once, in
their natural order, and used by name everywhere else.
"""

from __future__ import annotations

# --- fixed values: units -----------------------------------------------------
BYTES_PER_GIB = 1024**3
BYTES_PER_TIB = 1024**4
MS_PER_HOUR = 3_600_000
MS_PER_MINUTE = 60_000
MS_PER_SECOND = 1_000

# --- fixed values: monthly list prices, USD per GiB --------------------------
LOGICAL_ACTIVE_PRICE = 0.02
LOGICAL_LONG_TERM_PRICE = 0.01
PHYSICAL_ACTIVE_PRICE = 0.04
PHYSICAL_LONG_TERM_PRICE = 0.02
PRICING_NOTE = "Savings are indicative (based on US Multi-region list prices)"

# --- fixed values: cost reports ----------------------------------------------
FORECAST_DAYS = 30
FORECAST_NOTE = "Projections based on last %s days average"
BILLING_MODEL_OPTION = "storage_billing_model"
LOGICAL_BILLING = "LOGICAL"
PARTITION_CLAUSE_PATTERN = "%PARTITION BY%"

# --- fixed values: governance reports ----------------------------------------
PUBLIC_GROUPS = ("allUsers", "allAuthenticatedUsers")
PUBLIC_NOTE = "Detected via API scan"
ACTIVE_STATE = "ACTIVE"
IAM_RECOMMENDER = "google.iam.policy.Recommender"
PARTITION_RECOMMENDER = "google.bigquery.table.PartitionClusterRecommender"
MATERIALIZED_VIEW_PREFIX = "google.bigquery.materializedview"

# --- fixed values: slot saturation -------------------------------------------
DEFAULT_SLOT_LIMIT = 2000
SATURATION_HOURS = 6
WAIT_THRESHOLD_SEC = 2
HIGH_USAGE = 0.90
LOW_USAGE = 0.50
STATUS_CRITICAL = "CRITICAL: Saturation"
STATUS_QUEUING = "WARNING: Queuing (Concurrency)"
STATUS_OK = "OK"

# --- fixed values: partition key candidates ----------------------------------
LARGE_TABLE_BYTES = 10_737_418_240

# --- fixed values: data skew -------------------------------------------------
TAIL_LEVEL = 0.10
TAIL_RATIO = 0.50
SKEW_RATIO = 10
MIN_STAGE_MS = 1000
SKEW_CONFIRMED = (
    'CONFIRMED DATA SKEW: Stage "%s" imbalance (Max worker took %dx longer than Avg).'
)
SKEW_SERIAL = (
    "SERIAL BOTTLENECK: Long tail detected, but workers were balanced. "
    "Likely waiting on external locks or single-threaded operators."
)
SKEW_HEALTHY = "HEALTHY: No significant tail detected."
SKEW_INCONCLUSIVE = "INCONCLUSIVE"
DEFAULT_USER = "The user"
EXPLAIN_CONFIRMED = (
    "Your query isn't slow because of low compute. It's slow because %s has a large "
    "standard deviation in data distribution (e.g. one key has 10 million rows) and is "
    "jamming one worker. Rewriting with a salt/skew-join pattern will fix this. [%s]"
)
EXPLAIN_SERIAL = (
    "The query is waiting on a serial process (long tail), but individual workers seem "
    "balanced. This often indicates waiting on external locks, single-threaded "
    "operators, or output writing. [%s]"
)
EXPLAIN_HEALTHY = (
    "Query parallelism looks healthy. Slowness might be due to simply high data volume "
    "or complex calculations."
)
EXPLAIN_OTHER = "Analysis inconclusive. (%s)"

# --- fixed values: SQL anti-pattern rules ------------------------------------
# (code, must match, must not match or None, finding text); Java regex syntax.
ANTIPATTERN_RULES = (
    (
        "SELECT_STAR",
        r"(?idU)SELECT\s+\*\s+FROM",
        None,
        "SELECT *: Avoid selecting all columns. Select only specific columns to reduce "
        "cost and bytes processed.",
    ),
    (
        "ORDER_BY_RAND",
        r"(?idU)ORDER\s+BY\s+RAND\(\)",
        None,
        "ORDER BY RAND(): Extremely expensive operation (prevents caching, forces "
        "resorting). Use HASH() or pre-generated random columns.",
    ),
    (
        "ORDER_WITHOUT_LIMIT",
        r"(?idU)ORDER\s+BY",
        r"(?idU)LIMIT\s+(@\w+|\d+)",
        "ORDER BY without LIMIT: Sorting large result sets is expensive. (Note: Valid in "
        "Window Functions, but ensure partitioning is used).",
    ),
    (
        "REGEXP",
        r"(?idU)REGEXP_CONTAINS",
        None,
        "REGEXP_CONTAINS: Check if 'LIKE', 'STARTS_WITH', or 'ENDS_WITH' can be used "
        "instead for better performance.",
    ),
    (
        "LEADING_WILDCARD",
        r"""(?idU)LIKE\s+['"]%[^'"]+['"]""",
        None,
        "Leading Wildcard in LIKE: 'LIKE %...' prevents index usage. Use 'STARTS_WITH' or "
        "explicit search indexing.",
    ),
    (
        "CROSS_JOIN",
        r"(?idU)CROSS\s+JOIN",
        None,
        "CROSS JOIN: Avoid cross joins (Cartesian products) unless strictly necessary.",
    ),
    (
        "COMMA_JOIN",
        r"(?idU)FROM\s+[`a-zA-Z0-9_\.]+\s*,\s*[`a-zA-Z0-9_\.]+",
        None,
        "Comma Join / Implicit Cross Join: 'FROM t1, t2' detected. Prefer explicit JOIN "
        "syntax.",
    ),
    (
        "SINGLE_ROW_INSERT",
        r"(?idU)INSERT\s+INTO\s+.*VALUES\s*\(",
        None,
        "Single Row INSERT: Avoid frequent single-row inserts. Use batch loading or "
        "Streaming API.",
    ),
    (
        "STRING_CAST_FILTER",
        r"(?isU)(WHERE|JOIN).*CAST\(\s*\w+\s+AS\s+STRING\s*\)",
        None,
        "String Casting in Filter: Casting columns to STRING in WHERE/JOIN clauses "
        "prevents partition pruning.",
    ),
    (
        "IN_SUBQUERY",
        r"(?idU)IN\s*\(\s*SELECT",
        None,
        "Semi-Join (IN Subquery): IN (SELECT...) can be inefficient. Consider using EXISTS "
        "(for inclusion) or JOIN.",
    ),
    (
        "UNION_DISTINCT",
        r"(?idU)\s+UNION\s+(?!ALL)",
        None,
        "UNION usage: 'UNION' implies DISTINCT (expensive). Use 'UNION ALL' if duplicates "
        "are acceptable.",
    ),
)
NO_ANTIPATTERN = "None detected (check logic manually)"

# --- fixed values: environment scan ------------------------------------------
SNIPPET_CHARS = 200
# How far the scan's counts go when they are limited.
SCAN_LIMITS = {
    "time_travel": 20,
    "unused_tables": 50,
    "storage_model": 20,
    "iam_recommendations": 20,
    "slow_queries": 10,
    "unpartitioned": 20,
    "partitioning": 20,
}
SCAN_UNUSED_DAYS = 30
SCAN_SLOW_DAYS = 7
FINDING_FORECAST = "Projected Monthly Slot Hours: %s"
FINDING_TIME_TRAVEL = "Tables with heavy Time Travel costs: %s"
FINDING_UNUSED = "Unused Tables (30 days): %s"
FINDING_TOP_QUERY = "Top Query Cost: %s slot hrs"
FINDING_STORAGE = "Storage Optimization: %s tables"
FINDING_PUBLIC = "CRITICAL: Found %s publicly exposed datasets."
FINDING_NOT_PUBLIC = "Security: No public datasets found."
FINDING_IAM = "IAM Recommendations: %s"
FINDING_ERROR = "Top Query Error: %s"
FINDING_SLOT_HEALTH = "Slot Health: %s"
FINDING_SLOW = "Slow Queries (7 days): %s"
FINDING_UNPARTITIONED = "Unpartitioned Large Tables: %s"
FINDING_PARTITIONING = "Partitioning Opportunities: %s"
ERROR_LABELS = {"notFound": "Not Found"}
FINDING_SEPARATOR = " | "

# --- fixed values: transcripts -----------------------------------------------
TOOL_RESPONSE_KEY = "functionResponse"
TABLE_TOOLS = (
    "find_unused_tables",
    "analyze_storage_compression_model",
    "identify_large_unpartitioned_tables",
    "find_publicly_exposed_datasets",
    "get_top_time_travel_consumers",
    "get_expensive_queries_by_slot_hours",
    "forecast_monthly_costs",
    "check_table_permissions",
    "get_recent_table_users",
    "get_common_query_errors",
    "get_hourly_slot_consumption",
    "get_most_frequently_queried_tables",
    "check_slot_capacity_saturation",
    "suggest_partitioning_keys",
    "analyze_recent_queries_for_antipatterns",
    "get_partition_cluster_recommendations",
    "get_materialized_view_recommendations",
)
CHART_BLOCK = r"(?s)\[VEGA\](.*?)\[/VEGA\]"
CHART_WIDTH = 500
CHART_HEIGHT = 320
FOLLOW_UP_BLOCK = r"(?ds)\[FOLLOW_UP\](.*?)(\[/FOLLOW_UP\]|$)"
# Patterns removed from chat text, in order.
CHAT_REMOVALS = (
    r"(?s)\[VEGA\].*\[/VEGA\]",
    r"(?s)\[DASHBOARD_IMAGE\].*\[/DASHBOARD_IMAGE\]",
    r"\[DASHBOARD_GENERATED\]",
    r"(?ds)\[FOLLOW_UP\].*?(\[/FOLLOW_UP\]|$)",
)
# Patterns removed from report text, in order; the text is trimmed after each
# one except the last.
REPORT_REMOVALS = (
    r"(?ds)\[FOLLOW_UP\].*?(\[/FOLLOW_UP\]|$)",
    r"(?s)\[VEGA\].*?\[/VEGA\]",
    r"(?s)\[DASHBOARD_IMAGE\].*?\[/DASHBOARD_IMAGE\]",
    r"\[DASHBOARD_GENERATED\]",
    r"(?s)!\[.*?\]\(data:image.*?\)",
    r"""(?s)<img[^>]*?src=["']data:image.*?["'][^>]*?>""",
    r"(?U)data:image/[a-zA-Z0-9+.;=,/\s\-]+",
)
NO_CHAT_TEXT = "(No response text received from agent)"
NO_REPORT_TEXT = "# Error: No report content received."
TOOL_ERROR = "MCP Error: %s"
TOOL_ERROR_UNKNOWN = "Unknown error"
TOOL_NOT_JSON = "Invalid JSON response: %s"
TOOL_NOT_RECOGNISED = "MCP response format not recognized"
NO_TOOL_DATA = "Query executed successfully but returned no data."
# Characters that count as white space when text is trimmed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
