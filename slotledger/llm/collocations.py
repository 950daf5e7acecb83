"""Phrases whose words occur together far more often than their parts would.

Texts become sequences of word ids: one dictionary per language over all documents, in
which only words that occur ``least`` times have an id (``word_ids``). N-grams of two to
``longest`` words are counted level by level. Tasks put the n-grams of a shard into
counting quotient filters (``quotient_filter``), split by ranges of the permuted key; the
filters of a range are merged in one task, which keeps the n-grams that occur ``least``
times. An n-gram can only be that frequent if both n-grams one word shorter inside it
are, so tasks leave out all others: they look them up in a bitmap of the last level,
whose size is bounded (``MOST_BITS``). A bit set by chance lets an n-gram through that
its count then drops, so counts are exact whatever the bitmap lets pass.

Words: A-Z in lower case; a piece ends at ``.,;:!?`` and 0x0A-0x0D, its words are separated
by spaces and tabs. Phrases do not cross pieces. ``phrases`` gives, per language, all
surviving candidates or the best ``first``.

Edge cases: a null text counts as empty, a null lang as ``und``; rows are independent, so
repeated rows count each time and null ids do not matter. Without a frequent phrase the
result is empty. Columns other than text and lang are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotledger.llm.quotient_filter import Packing, filters, merged, summed
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
from slotledger.llm.words import as_bytes, grams, mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST, LONGEST, FIRST, INSIDE_PCT, SCALE = 100, 5, 2000, 100, 1000
UNKNOWN = "und"
BREAK = b"\xff"  # no UTF-8 text holds this byte
PIECES = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + 10 * BREAK
)
RANGE_KEYS, MOST_RANGE_BITS = 1 << 22, 14  # words a range; ranges at most
SLICE, HELD = 1 << 18, 1 << 20  # numbers in a row; n-grams that a task holds before it sums them
BITS_A_GRAM, MOST_BITS = 16, 1 << 30  # bitmap: 128 MB at most

SHARDS = f"{VOCABULARY}, n_words int, sequence binary"
_SHARDS = pa.schema([*VOCABULARY_FIELDS, ("n_words", pa.int32()), ("sequence", pa.binary())])
_IDS = pa.schema([("ids", pa.binary())])


def _shards(buckets: int) -> Callable:
    """Word numbers of the texts of a shard, -1 between pieces; the words of each language apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shard_ids()
        for taken in shards_of(batches):
            docs = pa.Table.from_batches(taken)
            blobs, parts = as_bytes(docs["text"].combine_chunks()), docs["part"].to_pylist()
            numbers, sequences, shard = Numbers(), [], next(ids)
            for part in sorted(set(parts)):
                whole = b"\n".join(b for b, p in zip(blobs, parts, strict=True) if p == part)
                spaced = whole.translate(PIECES).replace(BREAK, b" " + BREAK + b" ")
                found, _ = numbers.of(part, pa.array([spaced], pa.binary()))
                _, first, words = numbers.words[-1]
                at = words.index(BREAK).as_py()
                if at >= 0:
                    found = np.where(found == first + at, np.int32(-1), found)
                sequences.append(np.append(found, np.int32(-1)))
                del whole, spaced, found
            del blobs, docs
            counts = np.zeros(numbers.size, np.int64)
            for sequence in _slices(sequences):
                body = {"shard": [shard], "n_words": [numbers.size], "sequence": [squeezed(sequence + 1)]}
                yield batch(_SHARDS, {name: pa.array(v, _SHARDS.field(name).type) for name, v in body.items()})
                counts += np.bincount(sequence[sequence >= 0], minlength=numbers.size)
            for vocabulary in numbers.packed(shard, counts, buckets):
                yield batch(_SHARDS, vocabulary)

    return run


def _slices(sequences: list[np.ndarray]) -> Iterator[np.ndarray]:
    """About ``SLICE`` numbers at a time, cut between pieces: rows of bounded size."""
    for sequence in sequences:
        breaks, start = np.flatnonzero(sequence < 0), 0
        while start < len(sequence):
            cut = breaks[min(int(np.searchsorted(breaks, start + SLICE)), len(breaks) - 1)]
            yield sequence[start : cut + 1]
            start = int(cut) + 1


def _with_ids(row: dict, ids: np.ndarray) -> Iterable[pa.RecordBatch]:
    """The sequence in ids of the dictionary, -1 also for words that have none."""
    numbers = expanded(row["sequence"]) - 1
    out = np.append(ids, -1)[numbers].astype(np.int32)  # number -1 is the last place
    yield pa.RecordBatch.from_arrays([pa.array([squeezed(out + 1)], pa.binary())], schema=_IDS)


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """Starts of ``k`` words in a row that all have ids."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(words < 0)])
    return np.flatnonzero(bad[k : k + n] == bad[:n])


def _places(words: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Bit of the ``k`` words from each position on in a bitmap of ``bits`` bits."""
    return (grams(mix(words.astype(np.int64).astype(np.uint64)), k) & np.uint64(bits - 1)).astype(np.int64)


class Bitmap:
    """Which n-grams of one level may be frequent."""

    def __init__(self, k: int, content: np.ndarray):
        self.k, self.content, self.bits = k, content, len(content) * 8

    def has(self, words: np.ndarray) -> np.ndarray:
        """For each position whether the ``k`` words from it on may be frequent."""
        at = _places(words, self.k, self.bits)
        return (self.content[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _counted(k: int, bits: int, range_bits: int, known):
    """Filters of the n-grams of ``k`` words of each sequence."""
    packing = Packing(k, bits)

    def summary(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = summed(np.concatenate(held))
        made = list(filters(keys, counts, range_bits, packing))
        return pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part for part, _ in made], pa.int32()),
                "filter": pa.array([blob for _, blob in made], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter = known.value if known is not None else None
        held, size = [], 0
        for one in batches:
            for blob in one["ids"]:
                words = (expanded(blob.as_py()) - 1).astype(np.int32)
                starts = _runs(words, k)
                if shorter is not None and len(starts):
                    may = shorter.has(words)
                    starts = starts[may[starts] & may[starts + 1]]
                held.append(packing.scatter(words, starts))
                size += len(starts)
                if size >= HELD:
                    yield summary(held)
                    held, size = [], 0
        if size:
            yield summary(held)

    return run


def _frequent(k: int, bits: int, range_bits: int, least: int):
    """N-grams of one range that occur often enough over all shards."""
    packing = Packing(k, bits)

    def run(group: pa.Table) -> pa.Table:
        keys, counts = merged(group["filter"].to_pylist(), group["part"][0].as_py(), range_bits, packing)
        often = counts >= least
        words = packing.gather(keys[often]).astype(np.int32)
        ends = np.arange(len(words) + 1, dtype=np.int32) * k
        return pa.table({"gram": pa.ListArray.from_arrays(ends, words.ravel()), "f": counts[often]})

    return run


def _bitmap(grams_of: DataFrame, k: int) -> Bitmap:
    """Bitmap of the n-grams of a table; tasks send blocks, equal blocks are joined by OR."""
    count = grams_of.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_A_GRAM * max(count, 1) - 1).bit_length()))
    block = 1 << 16  # bits

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            words = one["gram"].flatten().to_numpy(zero_copy_only=False)
            at = np.unique(_places(words, k, bits)[::k])
            for start in np.unique(at // block):
                mine = at[(at >= start * block) & (at < (start + 1) * block)] - start * block
                content = np.zeros(block // 8, np.uint8)
                np.bitwise_or.at(content, mine >> 3, np.uint8(1) << (mine & 7).astype(np.uint8))
                yield pa.RecordBatch.from_pydict({"block": [int(start)], "content": [content.tobytes()]})

    def joined(group: pa.Table) -> pa.Table:
        content = reduce(np.bitwise_or, (np.frombuffer(b, np.uint8) for b in group["content"].to_pylist()))
        return pa.table({"block": group["block"][:1], "content": pa.array([content.tobytes()], pa.binary())})

    schema = "block long, content binary"
    blocks = grams_of.select("gram").mapInArrow(set_bits, schema).groupBy("block").applyInArrow(joined, schema)
    content = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():  # 8 kB each, MOST_BITS at most
        content[row["block"] * block // 8 :][: block // 8] = np.frombuffer(row["content"], np.uint8)
    return Bitmap(k, content)


def count_grams(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(gram, f)`` of all n-grams that occur ``least`` times, their words, and words a language.

    ``gram`` is an array of one to ``longest`` word ids; words have ``part, word, n, id``.
    """
    spark = docs.sparkSession
    wanted = docs.select(
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("part"),
    )
    shards = written(wanted.mapInArrow(_shards(buckets_for(docs)), SHARDS), "sequences")
    dictionary = Dictionary(shards, least)
    totals = written(dictionary.totals(), "totals")
    words = written(dictionary.words(), "frequent_words")
    n_ids = dictionary.size()
    n_all = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (n_ids - 1).bit_length()) if n_ids else 1
    if bits > 31:
        raise ValueError(f"{n_ids} frequent words; ids are kept in 31 bits")
    range_bits = min(MOST_RANGE_BITS, (n_all // RANGE_KEYS).bit_length())
    sequences = written(renumbered(shards, dictionary, _with_ids, "ids binary"), "ids")
    levels = [words.select(F.array(F.col("id").cast("int")).alias("gram"), F.col("n").alias("f"))]
    shorter = None
    for k in range(2, longest + 1):
        counted = sequences.mapInArrow(_counted(k, bits, range_bits, shorter), "part int, filter binary")
        found = counted.groupBy("part").applyInArrow(
            _frequent(k, bits, range_bits, least), "gram array<int>, f bigint"
        )
        found = written(found, f"grams{k}")
        levels.append(found)
        if k < longest:
            shorter = spark.sparkContext.broadcast(_bitmap(found, k))
    return reduce(DataFrame.unionByName, levels), words, totals


def phrases(
    docs: DataFrame,
    first: int | None = FIRST,
    least: int = LEAST,
    longest: int = LONGEST,
    inside_pct: int = INSIDE_PCT,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases."""
    counts, words, totals = count_grams(docs, least, longest)
    size = F.size("gram")
    candidates = counts.where(size >= 2).select("gram", F.col("f").alias("a"))
    # Dropped: part of a longer candidate that occurs (nearly) as often.
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("gram", i, m)),
        )
    )
    longer = (
        candidates.where(size > 2)
        .select(F.explode(spans).alias("gram"), F.col("a").alias("longer"))
        .groupBy("gram")
        .agg(F.max("longer").alias("longer"))
    )
    alone = candidates.join(longer, "gram", "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_pct)
    )
    cuts = alone.select("gram", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "gram", "a", "k",
        F.slice("gram", F.lit(1), F.col("k")).alias("left"),
        F.slice("gram", F.col("k") + 1, size - F.col("k")).alias("right"),
    )
    cuts = cuts.join(counts.select(F.col("gram").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("gram").alias("right"), F.col("f").alias("r")), "right")
    language = words.select(F.col("id").alias("_word"), "part").join(totals, "part")
    cuts = cuts.withColumn("_word", F.col("gram")[0].cast("long")).join(language, "_word")
    score = F.expr(
        f"(cast(a * {SCALE} AS decimal(18, 0)) * cast(n AS decimal(19, 0)))"
        " div (cast(l AS decimal(18, 0)) * cast(r AS decimal(19, 0)))"
    )
    scored = (
        cuts.withColumn("score", score)
        .groupBy("gram", "part", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    spelt = (
        scored.select("gram", F.posexplode("gram").alias("at", "_id"))
        .join(words.select(F.col("id").cast("int").alias("_id"), "word"), "_id")
        .groupBy("gram")
        .agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("of"))
        .select("gram", F.array_join("of.word", " ").alias("phrase"))
    )
    rows = scored.join(spelt, "gram").select(
        F.col("part").alias("lang"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if first is not None:  # pushed below the shuffle: a task sends no more than these
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def phrases_sql() -> str:
    """The same phrases in SQL (DuckDB): every n-gram of every piece is counted as text."""
    lower = """translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
    return f"""
    WITH pieces AS (
      SELECT coalesce(lang, '{UNKNOWN}') AS lang,
             unnest(regexp_split_to_array({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
    grams AS (SELECT lang, w[i:i + m - 1] AS g, m FROM places, (SELECT unnest(range(1, {LONGEST + 1})) AS m)
              WHERE i + m - 1 <= len(w)),
    f AS (SELECT lang, g, m, count(*) AS f FROM grams GROUP BY 1, 2, 3),
    totals AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY 1),
    often AS (SELECT * FROM f WHERE f >= {LEAST}),
    inner_of AS (
      SELECT o.lang, o.g[s:s + m2 - 1] AS g, max(o.f) AS longer
      FROM often o, (SELECT unnest(range(1, {LONGEST + 1})) AS s), (SELECT unnest(range(2, {LONGEST + 1})) AS m2)
      WHERE m2 < o.m AND s + m2 - 1 <= o.m GROUP BY 1, 2),
    alone AS (
      SELECT o.lang, o.g, o.m, o.f AS a FROM often o LEFT JOIN inner_of i ON o.lang = i.lang AND o.g = i.g
      WHERE o.m >= 2 AND (i.longer IS NULL OR 100 * i.longer < {INSIDE_PCT} * o.f)),
    cuts AS (SELECT a.*, k FROM alone a, (SELECT unnest(range(1, {LONGEST})) AS k) WHERE k < m),
    scored AS (
      SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, t.n,
             ({SCALE}::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
      FROM cuts c JOIN often l ON l.lang = c.lang AND l.g = c.g[1:c.k]
                  JOIN often r ON r.lang = c.lang AND r.g = c.g[c.k + 1:c.m]
                  JOIN totals t ON t.lang = c.lang),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    ranked AS (
      SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
             array_to_string(g, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
      FROM best)
    SELECT * FROM ranked WHERE rank <= {FIRST}
"""
