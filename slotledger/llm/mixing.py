"""Mixing sources to target weights by hash thresholds, by DataFrame functions only.

Every source gets its share of all words by weight, but at most ``max_copies``
times its own words; what it cannot take goes to the others by weight. A document
is taken whole, as often as its source's target goes into the source's size; the
fraction that remains is made up by the documents with the smallest hashes. The
threshold is found without sorting: words are summed by source and hash bucket,
the bucket in which the budget ends is refined with the next bits, and so on.
Documents of the last bucket (in practice one) are taken if that comes nearer to
the target.

The hash is that of the id and the text, so reruns agree. A row per source passes
through single tasks, document rows never do.

Edge cases: a null text has no words; a document without words is taken with
zero words. A null source is a source of its own, ordered last. Repeated rows
have one hash and are taken or left together. No documents give no rows. Other
columns are not read by ``mix``; ``mixed_documents`` keeps them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.llm.scratch import written

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
LEVELS = 4
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    parts = F.split(text, r"[\x20\x09-\x0D]+", -1)
    empty = F.element_at(parts, 1) == ""
    last = (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    return F.when(
        text.isNotNull(), F.size(parts) - empty.cast("int") - last.cast("int")
    ).otherwise(0).cast("long")


def hash_cell(text: Column) -> Column:
    """The document's place: a hash of ``LEVELS * LEVEL_BITS`` bits."""
    full = F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64(text))
    return F.shiftrightunsigned(full, 64 - LEVELS * LEVEL_BITS)


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row a source.

    With sources in the order of their limit for each unit of weight, the unit's
    share is final at the first source that does not reach its limit.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    limit = F.col("source_size") * F.lit(float(max_copies))
    rows = sources.withColumn("_weight", weight).withColumn("_limit", limit)
    rows = rows.withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    every = Window.partitionBy(F.lit(1))
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    rows = (
        rows.withColumn("_total", F.sum("source_size").over(every).cast("double"))
        .withColumn("_weights", F.sum("_weight").over(every))
        .withColumn("_full", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    )
    unit = (F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_used"))
    first = F.min(F.when(unit <= F.col("_ratio"), F.struct(F.col("_ratio"), (-unit).alias("_less"))))
    rows = rows.withColumn("_first", first.over(every))
    share = F.least("_limit", F.coalesce(-F.col("_first._less") * F.col("_weight"), F.col("_limit")))
    return rows.select("source", "source_size", share.alias("target"))


def thresholds(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """``source, source_size, target, copies, cell, last``: copies of every document, and one
    more of those below ``cell`` (of those in it too if ``last``)."""
    copies = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    state = aims.withColumn("copies", copies.cast("long")).withColumn(
        "left", F.col("target") - F.col("copies") * F.col("source_size")
    )
    state = written(state.withColumn("cell", F.lit(0).cast("long")), "cells")
    for level in range(LEVELS):
        below = (LEVELS - 1 - level) * LEVEL_BITS
        found = F.shiftrightunsigned("h", below)
        rows = sized.select(F.col("source").alias("_s"), found.alias("bucket"), "size")
        if level:  # only documents of each source's boundary bucket
            at = state.select(F.col("source").alias("_b"), "cell")
            rows = rows.join(
                at,
                F.col("_s").eqNullSafe(F.col("_b"))
                & (F.shiftrightunsigned("bucket", LEVEL_BITS) == F.col("cell")),
            )
        sums = rows.groupBy("_s", "bucket").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(run))
        # The budget ends in the first bucket whose running sum exceeds it.
        ends = (
            state.select("source", "left")
            .join(sums, F.col("source").eqNullSafe(F.col("_s")))
            .where(F.col("upto") > F.col("left"))
            .groupBy("source")
            .agg(
                F.min(F.struct("bucket", "upto", "words")).alias("_end"),
            )
        )
        ends = ends.select(
            F.col("source").alias("_e"),
            F.col("_end.bucket").alias("_bucket"),
            (F.col("_end.upto") - F.col("_end.words")).alias("_before"),
            F.col("_end.words").alias("_words"),
        )
        beyond = F.lit(1 << ((level + 1) * LEVEL_BITS)).cast("long")
        state = state.join(ends, F.col("source").eqNullSafe(F.col("_e")), "left").select(
            "source",
            "source_size",
            "target",
            "copies",
            (F.col("left") - F.coalesce("_before", F.lit(0))).alias("left"),
            F.coalesce("_bucket", beyond).alias("cell"),
            F.coalesce("_words", F.lit(0)).alias("words"),
        )
        state = written(state, "cells")
    last = F.abs(F.col("words") - F.col("left")) < F.abs(F.col("left"))
    return state.select("source", "source_size", "target", "copies", "cell", last.alias("last"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken, h`` of every row."""
    text = F.col("text").cast("string")
    sized = written(
        docs.select("doc_id", "source", word_count(text).alias("size"), hash_cell(text).alias("h")), "sized"
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = thresholds(sized, targets(sources, weights, max_copies))
    plan = plan.withColumnRenamed("source", "_source")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return _with_copies(rows, max_copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), "h",
    )


def _with_copies(rows: DataFrame, max_copies: int) -> DataFrame:
    more = (F.col("h") < F.col("cell")) | (F.col("last") & (F.col("h") == F.col("cell")))
    copies = F.least(F.col("copies") + more.cast("int"), F.lit(max_copies))
    return rows.withColumn("copies", copies.cast("long"))


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """The documents of the mix with all their columns, repeated as often as they are taken."""
    text = F.col("text").cast("string")
    sized = written(
        docs.select("source", word_count(text).alias("size"), hash_cell(text).alias("h")), "sized"
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = thresholds(sized, targets(sources, weights, max_copies))
    names = {name: f"_{name}_mix" for name in ("source", "copies", "cell", "last", "h", "copy")}
    while set(names.values()) & set(docs.columns):
        names = {k: v + "_" for k, v in names.items()}
    plan = plan.select(*[F.col(k).alias(names[k]) for k in ("source", "copies", "cell", "last")])
    rows = docs.withColumn(names["h"], hash_cell(text)).join(
        plan, F.col("source").eqNullSafe(F.col(names["source"]))
    )
    h, cell = F.col(names["h"]), F.col(names["cell"])
    more = (h < cell) | (F.col(names["last"]) & (h == cell))
    copies = F.least(F.col(names["copies"]) + more.cast("int"), F.lit(max_copies)).cast("int")
    repeated = F.explode(F.array_repeat(F.lit(1), copies))
    return rows.withColumn(names["copy"], repeated).select(*docs.columns)
