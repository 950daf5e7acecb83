"""A dictionary of words over all texts, and texts as shards of word numbers.

Tasks number the words of about ``SHARD_BYTES`` of text as they meet them and write a
shard: rows with the numbers, and its words, packed by buckets of their hash. The
dictionary is made bucket by bucket from the words of the shards, so a word is shuffled
once a shard, not once an occurrence, and in rows of many words. The same tasks tell
each shard the places its words have in their buckets; ``renumbered`` brings these to the
shard. Buckets grow in number with the input (``buckets_for``), so none grows with it much.

Words belong to a part (a language, or '' where there is only one); equal words of
different parts have different ids. Ids are 0, 1, 2, ... without gaps.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from slotledger.llm.scratch import written
from slotledger.llm.words import mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_BYTES = 8 << 20
LEAST_BUCKETS, MOST_BUCKETS = 32, 1 << 16
VOCABULARY = "shard bigint, bucket int, part string, locals binary, words binary, counts binary"
VOCABULARY_FIELDS = [
    ("shard", pa.int64()), ("bucket", pa.int32()), ("part", pa.string()), ("locals", pa.binary()),
    ("words", pa.binary()), ("counts", pa.binary()),
]
ENTRIES = "part string, bucket int, shard bigint, locals binary, codes binary, words binary, counts binary, n_all bigint, n_kept bigint"


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes: first all lowest bytes, then all second ones, and so on.

    Shards are written and shuffled; most of their numbers are small or close to each other.
    """
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    used = int(np.flatnonzero(planes.any(axis=1))[-1]) + 1 if planes.any() else 0
    content = planes[:used].tobytes()
    return bytes([used]) + len(values).to_bytes(8, "little") + pa.compress(content, codec="zstd", asbytes=True)


def expanded(blob: bytes) -> np.ndarray:
    """The numbers of ``squeezed``; they must not be negative."""
    used, n = blob[0], int.from_bytes(blob[1:9], "little")
    planes = np.zeros((8, n), np.uint8)
    if used and n:
        content = pa.decompress(blob[9:], decompressed_size=used * n, codec="zstd", asbytes=True)
        planes[:used] = np.frombuffer(content, np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _pressed(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def _unpressed(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def rising(values: np.ndarray) -> np.ndarray:
    """Steps between rising numbers, the first number first."""
    return np.diff(values, prepend=0)


def buckets_for(docs: DataFrame) -> int:
    """Number of buckets: four for each partition that the documents are read in."""
    partitions = docs.rdd.getNumPartitions()
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (4 * partitions - 1).bit_length()))


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each of some words, none empty; the same in every task."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    starts = ends[:-1] - ends[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(ends))
    weights = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat((data + np.uint64(1)) * weights[place & 255], starts))


class Numbers:
    """Numbers of the words of one shard: each call numbers the words of one part."""

    def __init__(self):
        self.size = 0
        self.words: list[tuple[str, int, pa.Array]] = []

    def of(self, part: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word of some texts, and how many words each text has.

        Words are separated by space and 0x09-0x0D. Texts may be binary.
        """
        texts = texts.view(pa.string()) if pa.types.is_binary(texts.type) else texts
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False)
        widths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        found = coded.dictionary.view(pa.binary())
        empty = pc.index(found, b"").as_py()  # at the ends of a text, or of a text without words
        if empty >= 0:
            real = numbers != empty
            before = np.concatenate([[0], np.cumsum(real)])
            ends = np.cumsum(widths)
            widths = before[ends] - before[ends - widths]
            numbers = numbers[real]
        numbers = numbers + np.int32(self.size)
        self.words.append((part, self.size, found))
        self.size += len(found)
        return numbers, widths

    def packed(self, shard: int, counts: np.ndarray, buckets: int) -> Iterator[dict[str, pa.Array]]:
        """Columns of the vocabulary, a row a bucket; ``counts`` has the occurrences of each number.

        Words that do not occur are left out.
        """
        for part, first, words in self.words:
            used = np.flatnonzero(counts[first : first + len(words)])
            if not len(used):
                continue
            mine = words.take(pa.array(used))
            bucket = (_hashes(mine) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, used, mine = bucket[order], used[order], mine.take(pa.array(order))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), mine)
            numbers, n = used + first, counts[used + first]
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield {
                "shard": pa.array(np.full(len(spans), shard)),
                "bucket": pa.array(bucket[cuts[:-1]]),
                "part": pa.array([part] * len(spans), pa.string()),
                "locals": pa.array([squeezed(rising(numbers[a:b])) for a, b in spans], pa.binary()),
                "words": pa.array([_pressed(text) for text in pc.binary_join(lists, b" ").to_pylist()], pa.binary()),
                "counts": pa.array([squeezed(n[a:b]) for a, b in spans], pa.binary()),
            }


def shard_ids() -> Iterator[int]:
    """Numbers of the shards that this task writes, different from those of all other tasks."""
    first = TaskContext.get().partitionId() << 32
    return iter(range(first, first + (1 << 32)))


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows with about ``SHARD_BYTES`` of ``text`` at a time; a row may be longer."""
    taken, size = [], 0
    for one in batches:
        lengths = pc.fill_null(pc.binary_length(one["text"]), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < len(ends):
            held = ends[start - 1] if start else 0
            stop = min(len(ends), int(np.searchsorted(ends, held + SHARD_BYTES - size)) + 1)
            taken.append(one.slice(start, stop - start))
            size += int(ends[stop - 1] - held)
            start = stop
            if size >= SHARD_BYTES:
                yield taken
                taken, size = [], 0
    if taken:
        yield taken


def batch(schema: pa.Schema, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of the given columns; the others are null."""
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema],
        schema=schema,
    )


def _entries(least: int) -> Callable:
    """One bucket of the dictionary, and where each shard's words are in it."""

    def run(group: pa.Table) -> pa.Table:
        part, bucket = group["part"][0].as_py(), group["bucket"][0].as_py()
        packed = pa.array(map(_unpressed, group["words"].to_pylist()), pa.binary()).view(pa.string())
        lists = pc.ascii_split_whitespace(packed)
        coded = lists.flatten().dictionary_encode()
        places = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.concatenate([expanded(x) for x in group["counts"].to_pylist()])
        totals = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(totals, places, counts)
        kept = totals >= least
        code = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        rows = []
        for shard, numbers, start, end in zip(
            group["shard"].to_pylist(), group["locals"].to_pylist(), [0, *ends[:-1]], ends, strict=True
        ):
            mine = code[places[start:end]]
            known = mine >= 0
            if known.any():
                numbers = rising(np.cumsum(expanded(numbers))[known])
                rows.append((part, bucket, shard, squeezed(numbers), squeezed(mine[known]), None, None, None, None))
        words = coded.dictionary.view(pa.binary()).filter(pa.array(kept)).to_pylist()
        rows.append(
            (part, bucket, None, None, None, b" ".join(words), totals[kept].tobytes(), int(totals.sum()), len(words))
        )
        kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
        names = [field.split()[0] for field in ENTRIES.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


class Dictionary:
    """Words that occur ``least`` times over all shards, with ids without gaps."""

    def __init__(self, shards: DataFrame, least: int = 1):
        vocabulary = shards.where("words IS NOT NULL").select(*[name for name, _ in VOCABULARY_FIELDS])
        self.entries = written(vocabulary.groupBy("part", "bucket").applyInArrow(_entries(least), ENTRIES), "entries")
        sizes = self.entries.where("shard IS NULL").select("part", "bucket", "n_kept")
        before = Window.orderBy("part", "bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
        self.firsts = sizes.select(
            "part", "bucket", F.coalesce(F.sum("n_kept").over(before), F.lit(0)).alias("first")
        )

    def totals(self) -> DataFrame:
        """``part, n``: occurrences of all words, those left out included."""
        return self.entries.where("shard IS NULL").groupBy("part").agg(F.sum("n_all").alias("n"))

    def size(self) -> int:
        return self.entries.agg(F.coalesce(F.sum("n_kept"), F.lit(0))).first()[0]

    def words(self) -> DataFrame:
        """``part, word, n, id`` of every word."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for one in batches:
                for row in one.to_pylist():
                    words = row["words"].split()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([row["part"]] * len(words), pa.string()),
                            "word": pa.array(words, pa.binary()),
                            "n": np.frombuffer(row["counts"], np.int64),
                            "id": np.arange(len(words)) + row["first"],
                        }
                    )

        packed = self.entries.where("shard IS NULL").join(self.firsts, ["part", "bucket"])
        return packed.select("part", "words", "counts", "first").mapInArrow(
            run, "part string, word binary, n bigint, id bigint"
        )


def renumbered(
    shards: DataFrame, words: Dictionary, use: Callable[[dict, np.ndarray], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """What ``use`` makes of each row of each shard and the ids of the shard's words.

    ``use`` gets the row and an array from number to id, -1 for words not in the dictionary. A
    shard and its words are bounded by ``SHARD_BYTES`` or one text.
    """
    bodies = shards.where("words IS NULL").drop(*[name for name, _ in VOCABULARY_FIELDS[1:]])
    mine = (
        words.entries.where("shard IS NOT NULL")
        .join(words.firsts, ["part", "bucket"])
        .select(F.col("shard").alias("of_shard"), "first", "locals", "codes")
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, rows = [], left.to_pylist()
        ids = np.full(max((row["n_words"] for row in rows), default=0), -1, np.int64)
        for some in right.to_pylist():
            ids[np.cumsum(expanded(some["locals"]))] = expanded(some["codes"]) + some["first"]
        for row in rows:
            out.extend(use(row, ids))
        return pa.Table.from_batches(out)

    return bodies.groupBy("shard").cogroup(mine.groupBy("of_shard")).applyInArrow(run, schema)
