"""Anti-pattern reports over SQL texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger import fixed_values as fv
from slotledger.functions.antipatterns import finding_codes, finding_texts
from slotledger.functions.clock import last_days
from slotledger.functions.measures import gib, slot_hours
from slotledger.functions.topk import best_per_text


def detect_antipatterns(texts: DataFrame, column: str = "query") -> DataFrame:
    """Add ``rule_codes`` and ``findings`` (arrays, rule order) to each SQL text.

    Map-only: the rules are native columns, evaluated where the text is read.
    """
    return texts.withColumn("rule_codes", finding_codes(F.col(column))).withColumn(
        "findings", finding_texts(F.col("rule_codes"))
    )


def antipattern_queries(
    jobs: DataFrame,
    as_of: datetime | None = None,
    days: int | None = 30,
    k: int | None = 10,
) -> DataFrame:
    """Heaviest run of each distinct SELECT text, top ``k``, with its findings.

    ``k=None`` keeps every text, ``days=None`` takes the whole history.
    """
    selects = (
        last_days(jobs, "creation_time", as_of, days)
        .where(F.col("statement_type") == "SELECT")
        .select("user_email", "job_id", "query", "total_bytes_processed", "total_slot_ms")
    )
    heaviest = best_per_text(selects, "query", "total_slot_ms", k, F.col("job_id"))
    found = finding_texts(finding_codes(F.col("query")))
    none = F.array(F.lit(fv.NO_ANTIPATTERN))
    return heaviest.select(
        "user_email",
        "job_id",
        "query",
        F.round(gib(F.col("total_bytes_processed")), 2).alias("gb_processed"),
        F.round(slot_hours(F.col("total_slot_ms")), 2).alias("slot_hours"),
        F.when(F.size(found) > 0, found).otherwise(none).alias("detected_antipatterns"),
    )
