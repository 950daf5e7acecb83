"""Active recommendations of one recommender, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger import fixed_values as fv
from slotledger.functions.topk import top

_OUTPUT = (
    "last_updated_time",
    "description",
    "target_resources",
    "primary_impact",
    "additional_details",
)


def active(recommendations: DataFrame, recommender: Column) -> DataFrame:
    return recommendations.where(recommender & (F.col("state") == fv.ACTIVE_STATE))


def _newest(recommendations: DataFrame, recommender: Column, k: int | None) -> DataFrame:
    found = active(recommendations, recommender)
    return top(found, k, F.desc("last_updated_time"), F.col("recommendation_id")).select(*_OUTPUT)


def from_iam() -> Column:
    return F.col("recommender") == fv.IAM_RECOMMENDER


def from_partitioning() -> Column:
    return F.col("recommender") == fv.PARTITION_RECOMMENDER


def from_materialized_views() -> Column:
    return F.col("recommender").startswith(fv.MATERIALIZED_VIEW_PREFIX)


def iam_recommendations(recommendations: DataFrame, k: int = 20) -> DataFrame:
    return _newest(recommendations, from_iam(), k)


def partition_cluster_recommendations(recommendations: DataFrame, k: int = 20) -> DataFrame:
    return _newest(recommendations, from_partitioning(), k)


def materialized_view_recommendations(recommendations: DataFrame, k: int = 20) -> DataFrame:
    return _newest(recommendations, from_materialized_views(), k)
