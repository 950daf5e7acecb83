"""Slot saturation minute by minute, as the timeline and the jobs arrive.

Both histories are streams. Each is reduced to one-minute windows behind a watermark,
and the windows of slot use are joined with those of waits: a stream-stream left
join, since a minute may have no jobs. A minute is given out once, when neither stream
can bring rows of it any more, that is when both watermarks (the newest time seen less
``delay``) have passed its end. Rows within ``delay`` count wherever they arrive; later
ones are dropped, as is a row without a time. State holds the open minutes only, one
row a minute and side, however many rows a minute has.

The minutes are those of ``performance.slot_saturation`` with neither ``hours`` nor ``k``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotledger.operators import performance
from slotledger.schemas import view_schema

MINUTE = "1 minute"
DELAY = "10 minutes"
#: Time stamp of each history that can be streamed.
TIMES = {"jobs": "creation_time", "jobs_timeline": "period_start"}


def view_stream(
    spark: SparkSession, root: str, view: str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """``root/<view>`` as a stream of files, with the declared schema; ``max_files`` a batch."""
    reader = spark.readStream.schema(view_schema(view)).format(fmt).option("recursiveFileLookup", "true")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(f"{root}/{view}")


def end_row(spark: SparkSession, view: str, at: datetime) -> DataFrame:
    """A row of ``view`` that only says that time has come to ``at``.

    Written as the last file of a history that ends, it completes all minutes before ``at``
    less the delay; its own minute is never given out.
    """
    values = {TIMES[view]: F.lit(at), "job_type": F.lit("QUERY")}
    columns = [
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in view_schema(view).fields
    ]
    return spark.range(1).select(*columns)


def minutes(jobs: DataFrame, jobs_timeline: DataFrame, delay: str = DELAY) -> DataFrame:
    """``time_bucket, avg_slots_used, jobs_submitted, avg_wait_sec`` of complete minutes."""
    used = (
        jobs_timeline.select("period_start", "period_slot_ms")
        .withWatermark("period_start", delay)
        .groupBy(F.window("period_start", MINUTE).alias("minute"))
        .agg(performance.mean_slots().alias("avg_slots_used"))
    )
    waits = (
        jobs.select("creation_time", "start_time", "job_id", "job_type")
        .withWatermark("creation_time", delay)
        .where(performance.is_query())
        .groupBy(F.window("creation_time", MINUTE).alias("minute"))
        .agg(*performance.wait_measures())
    )
    joined = used.join(waits, "minute", "left")
    return joined.select(F.col("minute.start").alias("time_bucket"), *joined.columns[1:])


def saturation_stream(
    jobs: DataFrame,
    jobs_timeline: DataFrame,
    reservations: DataFrame,
    assignments: DataFrame,
    project_id: str,
    delay: str = DELAY,
) -> DataFrame:
    """Slot use against the limit for each complete minute.

    ``reservations`` and ``assignments`` are tables: the limit is read when the stream starts.
    """
    limit = performance.slot_limit(reservations, assignments, project_id).first()["system_slot_limit"]
    found = minutes(jobs, jobs_timeline, delay)
    return performance.judged_minutes(found.withColumn("system_slot_limit", F.lit(limit).cast("bigint")))


def write_minutes(
    stream: DataFrame, path: str, checkpoint: str, once: bool = False, every: str | None = None
) -> StreamingQuery:
    """Append complete minutes to Parquet files in ``path``, each exactly once.

    ``checkpoint`` holds positions and open minutes; a query started with it again goes on
    where it stopped, whatever stopped it. ``once`` takes what is there and ends.
    """
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    elif every is not None:
        writer = writer.trigger(processingTime=every)
    return writer.start()
