"""Session settings the reports are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings only; sizes (executors, memory, shuffle partitions) belong to
# the cluster. AQE coalesces small shuffles, splits skewed join partitions, and
# switches joins to broadcast or to hash joins from measured sizes: a hash join
# is taken only where every partition of its built side is within the limit. A
# skewed join partition is split even if the aggregation above it then needs a
# shuffle: that one moves partial results only.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A key that occurs twice in a JSON object counts with its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(
    app_name: str = "slotledger", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with the package defaults, then ``conf`` on top."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the package defaults on an existing session."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark
