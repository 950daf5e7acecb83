"""A filter of fixed size that spares a join most rows it would drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BLOCKS, FILTER_WORDS = 4096, 128


def maybe_in(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` without most of those whose value is not in ``wanted``; none of the others is lost.

    A bit for each hash, 2**25 bits whatever the input: the table that is broadcast has
    ``FILTER_BLOCKS`` rows of ``FILTER_WORDS`` numbers. It saves shuffling texts that the
    join would drop; with very many wanted values it lets all rows through.
    """
    hashed = F.xxhash64(name)
    block = F.pmod(hashed, F.lit(FILTER_BLOCKS))
    word = F.pmod(F.shiftrightunsigned(hashed, 16), F.lit(FILTER_WORDS))
    bit = F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
    bits = (
        wanted.select(block.alias("_block"), word.alias("_word"), bit.alias("_bit"))
        .groupBy("_block", "_word")
        .agg(F.bit_or(one).alias("_set"))
        .groupBy("_block")
        .agg(F.map_from_entries(F.collect_list(F.struct("_word", "_set"))).alias("_words"))
    )
    found = F.getbit(F.coalesce(F.col("_words")[word], F.lit(0).cast("long")), bit) == 1
    return (
        rows.withColumn("_block", block)
        .join(F.broadcast(bits), "_block")
        .where(found)
        .select(*rows.columns)
    )
