"""Reports over long windows from partial results kept by day.

``DayPartials.fold`` reduces each day folder of the job history to three small tables, laid
out by day: slot use and billed bytes by hour, errors by reason, references by table. A
list of folded folders tells their files apart, so a folder that is new or has changed
(late files) is folded again and no other is read. A report takes the days that lie wholly
inside its window from the partials; the two days at its ends, and days that are not
folded as they are now, it reads from the history. So its rows are always those of the
full scan, whatever ``as_of`` is and whether or not ``fold`` ran.

The history must be laid out in ``dt=<date>`` folders by UTC date of ``creation_time``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.functions.clock import DAY_PARTITION, last_days, resolve
from slotledger.operators import cost, performance
from slotledger.sources.warehouse import Warehouse

#: What is kept of a day, by name: how it is computed, and its columns.
PARTIALS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "usage": (cost.usage_by_hour, "usage_date date, hour_of_day int, slot_ms bigint, billed bigint"),
    "errors": (performance.errors_by_reason, "reason string, error_count bigint"),
    "references": (performance.reference_counts, "table_id string, dataset_id string, query_count bigint"),
}
FOLDED = "files bigint, bytes bigint, newest timestamp, names bigint"


class DayPartials:
    """Partial results of the history of ``wh`` in the folder ``root``.

    ``jobs_path`` is where the history's day folders are.
    """

    def __init__(self, wh: Warehouse, jobs_path: str, root: str):
        if DAY_PARTITION not in wh.jobs.columns:
            raise ValueError(f"the job history has no day folders ({DAY_PARTITION})")
        self.wh, self.jobs_path, self.root = wh, jobs_path.rstrip("/"), root.rstrip("/")

    def folders(self) -> DataFrame:
        """Day folders as they are: number, size, newest time and names of their files."""
        files = self.wh.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.jobs_path)
        day = F.regexp_extract("path", rf"/{DAY_PARTITION}=([0-9-]+)/[^/]*\z", 1).cast("date")
        return files.groupBy(day.alias(DAY_PARTITION)).agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("length").alias("bytes"),
            F.max("modificationTime").alias("newest"),
            F.bit_xor(F.xxhash64("path")).alias("names"),
        )

    def _table(self, name: str, columns: str) -> DataFrame:
        schema = f"{columns}, {DAY_PARTITION} date"
        try:
            return self.wh.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.wh.spark.createDataFrame([], schema)

    def _replace(self, rows: DataFrame, name: str) -> None:
        """Replace the day folders that ``rows`` has."""
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(DAY_PARTITION).parquet(f"{self.root}/{name}")

    def folded_days(self) -> list[date]:
        """Days whose folders are as they were when they were folded; a value a day."""
        now, then = self.folders(), self._table("folded", FOLDED)
        same = now.join(then, [DAY_PARTITION, "files", "bytes", "newest", "names"])
        return sorted(row[0] for row in same.select(DAY_PARTITION).collect())

    def fold(self) -> list[date]:
        """Fold the folders that are new or have changed; their days.

        The list is written last: a run that breaks off folds the same days again.
        """
        now = self.folders().where(F.col(DAY_PARTITION).isNotNull())
        done = self.folded_days()
        fresh = [r for r in now.collect() if r[DAY_PARTITION] not in set(done)]  # a row a day
        if not fresh:
            return []
        days = sorted(r[DAY_PARTITION] for r in fresh)
        self.wh.refresh()
        jobs = self.wh.jobs.where(F.col(DAY_PARTITION).isin(days))
        for name, (reduce_jobs, _) in PARTIALS.items():
            self._replace(self._by_day(jobs, reduce_jobs), name)
        listed = self.wh.spark.createDataFrame([tuple(r) for r in fresh], now.schema)
        self._replace(listed.coalesce(1), "folded")
        return days

    @staticmethod
    def _by_day(jobs: DataFrame, reduce_jobs: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Partial results of each day: the reduction's own keys and sums, and the day."""
        if reduce_jobs is cost.usage_by_hour:
            return reduce_jobs(jobs).withColumn(DAY_PARTITION, F.col("usage_date"))
        if reduce_jobs is performance.errors_by_reason:
            failed = jobs.where(F.col("error_result").isNotNull())
            return failed.groupBy(F.col("error_result.reason").alias("reason"), DAY_PARTITION).agg(
                F.count(F.lit(1)).alias("error_count")
            ).select("reason", "error_count", DAY_PARTITION)
        return cost.table_references(jobs, DAY_PARTITION).groupBy("table_id", "dataset_id", DAY_PARTITION).agg(
            F.count(F.lit(1)).alias("query_count")
        ).select("table_id", "dataset_id", "query_count", DAY_PARTITION)

    def parts(self, name: str, as_of: datetime | None, days: int) -> DataFrame:
        """Partial results of the last ``days``, several a key."""
        end = resolve(as_of).astimezone(timezone.utc)
        start = end - timedelta(days=days)
        inside = [d for d in self.folded_days() if start.date() < d < end.date()]
        reduce_jobs, columns = PARTIALS[name]
        rest = last_days(self.wh.jobs, "creation_time", end, days)
        kept = self._table(name, columns)
        if not inside:
            return reduce_jobs(rest)
        # Days are few; as literals they prune folders of both tables.
        rest = rest.where(~F.col(DAY_PARTITION).isin(inside))
        return kept.where(F.col(DAY_PARTITION).isin(inside)).drop(DAY_PARTITION).unionByName(reduce_jobs(rest))

    def forecast_monthly_costs(self, as_of: datetime | None = None, days: int = 30) -> DataFrame:
        return cost.forecast_of(self.parts("usage", as_of, days), days)

    def hourly_slot_consumption(self, as_of: datetime | None = None, days: int = 30) -> DataFrame:
        return performance.hourly_slots(self.parts("usage", as_of, days))

    def common_query_errors(
        self, as_of: datetime | None = None, days: int = 30, k: int | None = 10
    ) -> DataFrame:
        parts = self.parts("errors", as_of, days)
        counted = parts.groupBy("reason").agg(F.sum("error_count").alias("error_count"))
        return performance.most_frequent_errors(counted, k)

    def frequent_tables(
        self, as_of: datetime | None = None, days: int = 30, k: int | None = 20
    ) -> DataFrame:
        parts = self.parts("references", as_of, days)
        counted = parts.groupBy("table_id", "dataset_id").agg(F.sum("query_count").alias("query_count"))
        return performance.most_read_tables(counted, k)

    def unused_tables(
        self, as_of: datetime | None = None, days_inactive: int = 180, k: int | None = 50
    ) -> DataFrame:
        used = cost.names_of(self.parts("references", as_of, days_inactive))
        return cost.largest_tables(cost.stored_but_not(self.wh.table_storage, used), k)
