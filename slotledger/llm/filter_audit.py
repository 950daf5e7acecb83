"""What each of five document filters removes, in every order of applying them.

The words of all texts become a sparse document-term matrix: words get ids from one
dictionary over all documents (``word_ids``), and shards of documents hold their
counts as compressed sparse rows (row ends, column ids, counts). The sum of a row is
the document's number of words, its stored entries are its distinct words; they decide
filters A and B. C (capitals) and D (marks) are found in the same pass over the texts, E (an
equal text with a smaller id) by grouping hashes. Documents then collapse to counts
by part, failed filters and labels, from which all orders are worked out.

Filters, each failed by a document with: A under 100 words; B 100 * distinct words <
80 * words; C 100 * capitals A-Z > 10 * code points; D any of ``#$%&*|``; E the text of a
smaller doc_id.

Edge cases: a null text counts as empty (it fails A; E too, if an empty text has a
smaller id). A null lang is the part ''. A row without doc_id never fails E and makes no
other row fail it; rows that repeat an id do not fail because of each other. A
document is good or toxic if any label row of its id says 1. No documents give no rows.
Columns other than doc_id, text and lang (labels: doc_id, quality, toxic) are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotledger.llm.scratch import written
from slotledger.llm.word_ids import (
    VOCABULARY,
    VOCABULARY_FIELDS,
    Dictionary,
    Numbers,
    batch,
    buckets_for,
    expanded,
    renumbered,
    shard_ids,
    shards_of,
    squeezed,
)
from slotledger.llm.words import as_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT = 100, 80, 10
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLICE, MOST_DOCS = 1 << 17, 1 << 12  # words and documents in a row
MARKS = b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))  # UTF-8 bytes that start no code point

SHARDS = (
    f"{VOCABULARY}, n_words int, doc_ids array<bigint>, parts array<string>, hashes array<binary>, "
    "flags binary, row_ends binary, cells binary, repeats binary"
)
ROWS = "doc_id bigint, part string, hash binary, mask int, n_words bigint, n_distinct bigint"


_SHARDS = pa.schema(
    [*VOCABULARY_FIELDS, ("n_words", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.string())),
     ("hashes", pa.list_(pa.binary())), *[(name, pa.binary()) for name in ("flags", "row_ends", "cells", "repeats")]]
)
_ROWS = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.string()), ("hash", pa.binary()), ("mask", pa.int32()),
     ("n_words", pa.int64()), ("n_distinct", pa.int64())]
)


def _own_flags(blob: bytes) -> int:
    """Filters C and D as bits."""
    capitals = len(blob) - len(blob.translate(None, CAPITALS))
    points = len(blob.translate(None, CONTINUED))
    marked = len(blob.translate(None, MARKS)) < len(blob)
    return (100 * capitals > MOST_CAPITALS_PCT * points) << 2 | marked << 3


def _rows(shard: int, taken: list[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of the matrix, with the shard's own column numbers, and the shard's words."""
    docs = pa.Table.from_batches(taken).combine_chunks()
    texts = pc.fill_null(docs["text"].combine_chunks(), "")
    numbers = Numbers()
    words, widths = numbers.of("", texts)
    blobs = as_bytes(texts)
    total = np.zeros(numbers.size, np.int64)
    for start, stop in _slices(widths):
        docs_of, words_of = docs.slice(start, stop - start), words[: widths[start:stop].sum()]
        words = words[len(words_of) :]
        rows = np.repeat(np.arange(stop - start), widths[start:stop])
        cells, counts = np.unique(rows << 32 | words_of, return_counts=True)
        columns = (cells & 0xFFFFFFFF).astype(np.int32)
        body = {
            "shard": [shard], "n_words": [numbers.size],
            "doc_ids": [docs_of["doc_id"].to_pylist()], "parts": [docs_of["part"].to_pylist()],
            "hashes": [[hashlib.sha256(blob).digest()[:16] for blob in blobs[start:stop]]],
            "flags": [bytes(map(_own_flags, blobs[start:stop]))],
            "row_ends": [np.cumsum(np.bincount(cells >> 32, minlength=stop - start)).tobytes()],
            # Columns rise within a row, so steps are small; so are most counts.
            "cells": [squeezed(_steps(columns, cells >> 32))], "repeats": [squeezed(counts)],
        }
        yield batch(_SHARDS, {name: pa.array(value, _SHARDS.field(name).type) for name, value in body.items()})
        np.add.at(total, columns, counts)
    for vocabulary in numbers.packed(shard, total, buckets):
        yield batch(_SHARDS, vocabulary)


def _steps(columns: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Steps between the columns of a row; a row's first column as it is."""
    steps = np.diff(columns, prepend=0)
    new = np.diff(rows, prepend=-1) != 0
    steps[new] = columns[new]
    return steps


def _slices(widths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``SLICE`` words, or one document: rows of bounded size."""
    ends, start = np.cumsum(widths), 0
    while start < len(ends):
        held = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + SLICE, side="right")))
        stop = min(stop, start + MOST_DOCS)
        yield start, stop
        start = stop


def _shards(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shard_ids()
        for taken in shards_of(batches):
            yield from _rows(next(ids), taken, buckets)

    return run


def _judged(row: dict, ids: np.ndarray) -> Iterable[pa.RecordBatch]:
    """Filters A to D of a shard's documents; A and B from the matrix with global columns."""
    ends, counts = np.frombuffer(row["row_ends"], np.int64), expanded(row["repeats"])
    summed = np.concatenate([[0], np.cumsum(expanded(row["cells"]))])
    widths = np.diff(ends, prepend=0)
    columns = ids[summed[1:] - np.repeat(summed[ends - widths], widths)]
    sums = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], ends])])
    stored = np.diff(np.concatenate([[0], np.cumsum(columns >= 0)])[np.concatenate([[0], ends])])
    mask = np.frombuffer(row["flags"], np.uint8).astype(np.int32)
    mask = mask | (sums < LEAST_WORDS) | (100 * stored < LEAST_DISTINCT_PCT * sums) << 1
    columns = [row["doc_ids"], row["parts"], row["hashes"], mask, sums, stored]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS
    )


def matrix_shards(docs: DataFrame) -> DataFrame:
    """Shards of the document-term matrix, with their own column numbers and vocabularies."""
    wanted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
    )
    return written(wanted.mapInArrow(_shards(buckets_for(docs)), SHARDS), "matrix")


def judged_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, part, hash, mask, n_words, n_distinct``: filters A to D as bits of ``mask``."""
    shards = matrix_shards(docs)
    return renumbered(shards, Dictionary(shards), _judged, ROWS)


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters they fail (bit 0 is A, bit 4 is E)."""
    labelled = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    rows = judged_documents(docs).join(labelled, "doc_id", "left").select(
        "doc_id", "part", "hash", "mask",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    # Equal texts share a hash and the filters A to D, so of each text there is only what tells its
    # rows apart: part, labels, and which has the smallest id. A text of very many documents
    # meets as a few rows a task.
    kind = ["hash", "part", "mask", "good", "toxic"]
    one = rows.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    alike = one.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    first_id = F.min("first.doc_id").over(Window.partitionBy("hash"))  # a few rows a text
    alike = alike.withColumn("holds_first", F.col("first.doc_id") == first_id)
    spared = F.col("nameless") + F.when(F.col("holds_first"), F.col("first.n")).otherwise(0)
    split = alike.select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask").alias("mask"), spared.alias("n")),
            F.struct((F.col("mask").bitwiseOR(16)).alias("mask"), (F.col("n") - spared).alias("n")),
        )),
    )
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: what that step keeps and removes."""
    counts = written(failure_counts(docs, labels), "failures")  # at most 32 rows a part
    orders = " ".join(map("".join, itertools.permutations(FILTERS)))
    before, letter = "left(filter_order, step - 1)", "substr(filter_order, step, 1)"
    bits = [f"if(contains({{among}}, '{x}'), {1 << i}, 0)" for i, x in enumerate(FILTERS)]
    ordered = (
        counts.select("*", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
        .withColumn("own", F.expr(" + ".join(bits).format(among=letter)))
        .withColumn("earlier", F.expr(" + ".join(bits).format(among=before)))
    )
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0
    removed = fails & ~gone

    def total(condition, of: str = "n"):
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")

    found = (
        ordered.groupBy("part", "filter_order", "step", "own")
        .agg(
            total(~fails & ~gone).alias("kept"),
            total(removed).alias("removed"),
            total(fails & gone).alias("redundant"),
            total(F.col("mask") == F.col("own")).alias("unique_fails"),
            total(removed, "good").alias("good_lost"),
            total(removed, "toxic").alias("toxic_lost"),
        )
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "own"))  # 120 rows a part and filter
    return found.withColumn("shapley", shapley).drop("own")


def audit_sql() -> str:
    """The same audit in SQL (DuckDB), straight from the texts."""
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(FILTERS))
    return f"""
    WITH RECURSIVE worded AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
      FROM documents),
    told AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
    judged AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < {LEAST_WORDS} THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT_PCT} * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))
                    > {MOST_CAPITALS_PCT} * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
      FROM worded LEFT JOIN told USING (doc_id)),
    counted AS (
      SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY 1, 2),
    letters(letter, bit) AS (VALUES {letters}),
    orders AS (
      SELECT letter AS filter_order, bit AS used, 0 AS earlier, bit AS own, 1 AS step FROM letters
      UNION ALL
      SELECT filter_order || letter, used + bit, used, bit, step + 1 FROM orders, letters WHERE used & bit = 0),
    steps AS (
      SELECT whole.filter_order, part_of.step, part_of.earlier, part_of.own
      FROM orders whole JOIN orders part_of
        ON whole.step = 5 AND substr(whole.filter_order, 1, part_of.step) = part_of.filter_order),
    found AS (
      SELECT part, filter_order, step, own,
        sum(CASE WHEN mask & own = 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM counted, steps GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM found
"""
