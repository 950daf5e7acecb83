"""Exact top-k over distinct values without shuffling the wide rows.

``distinct`` or "best row per text" followed by a limit would shuffle every
wide row (SQL texts, mostly) only to throw nearly all of them away. Distinct rows
are cut by a rank inside hash buckets, which runs in each task. For the best row of each
text a lower bound of the result is found first, from values that combine on the map
side to a bounded number per task. The bound is a scalar subquery, one value
whatever the input size; where there are fewer than ``k`` candidates it is null and
nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT_BUCKETS = 1 << 16
ROW_BUCKETS = 1 << 8


def top(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """First ``k`` rows by ``order``; only ordered when ``k`` is None."""
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(k)


def _at_or_above(df: DataFrame, column: str, candidates: DataFrame, k: int) -> DataFrame:
    """Keep rows of ``df`` not below the ``k``-th largest candidate ``bound``."""
    best = candidates.where(F.col("bound").isNotNull()).orderBy(F.desc("bound")).limit(k)
    bound = best.agg(
        F.when(F.count(F.lit(1)) >= k, F.min("bound")).alias("bound")
    ).scalar()
    return df.where(bound.isNull() | (F.col(column) >= bound))


def newest_distinct(
    df: DataFrame, column: str, k: int | None, *ties: Column, buckets: int = ROW_BUCKETS
) -> DataFrame:
    """The ``k`` distinct rows with the largest ``column``; all when None.

    A row with one of the ``k`` largest distinct values has one of them in its hash bucket
    too, and each value comes with a distinct row at least. So rows beyond them are
    cut inside each task, before anything is shuffled, in one pass.
    """
    if k is not None:
        bucket = F.pmod(F.xxhash64(*df.columns), F.lit(buckets))
        order = Window.partitionBy("_bucket").orderBy(F.desc_nulls_last(column))
        ranked = df.withColumn("_bucket", bucket).withColumn("_rank", F.dense_rank().over(order))
        df = ranked.where(F.col("_rank") <= k).drop("_bucket", "_rank")
    return top(df.distinct(), k, F.desc(column), *ties)


def best_per_text(
    df: DataFrame,
    text: str,
    column: str,
    k: int | None,
    tie: Column,
    buckets: int = TEXT_BUCKETS,
) -> DataFrame:
    """For each distinct ``text`` its row with the largest ``column``; the top ``k`` of those.

    All of them, in no order, when ``k`` is None.

    The bound comes from the best value of each hash bucket. Texts that share a
    bucket can only merge candidates, which lowers the bound, so the result
    stays exact.
    """
    if k is not None:
        bucket = F.pmod(F.xxhash64(text), F.lit(buckets))
        candidates = df.groupBy(bucket.alias("bucket")).agg(F.max(column).alias("bound"))
        df = _at_or_above(df, column, candidates, k)
    rank = F.row_number().over(Window.partitionBy(text).orderBy(F.desc(column), tie))
    best = df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
    return best if k is None else top(best, k, F.desc(column), F.col(text))
