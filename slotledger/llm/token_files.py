"""Token ids of documents in compressed files.

``write_files`` orders documents by id, encodes whole texts, appends an end id to
each and writes blocks of ids as range-coded bytes (``rans``) with one frequency
table for all blocks. A file set is a folder with ``table`` (symbol, freq) and
``blocks`` (part, block, doc_ids, sizes, n_tokens, payload), both Parquet: the
container that every Spark store can hold. Blocks hold whole documents and can
be decoded in any order, each also from its checkpoints. ``read_files`` decodes
them and tells where each document starts in the whole sequence.

White space separates words for this tokenizer family (it is dropped before the
merges) and case is ignored, so each distinct word is encoded once and kept in
caches of fixed size. Added tokens of the tokenizer file count as such wherever they stand
in a text, as the library has it.

Edge cases: a null text counts as empty and has the end id only. Null ids come
first; rows with one id are ordered by the hash of their text and each keep a
place of their own. No documents give an empty file set. Columns other than id
and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from slotledger.llm.rans import Table, crc_of, decode_block, encode_block, quantise
from slotledger.llm.scratch import new_path, written
from slotledger.llm.words import as_bytes, chunks
from slotledger.llm.workers import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHE_WORDS = 250_000  # of each generation
#: Lower-case words of printable ASCII: how this tokenizer family splits them (fixed values).
PLAIN = re.compile(rb"[!-@\[-~]+").fullmatch
PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
MARKS = "\U0001f602\u2192\u2026"
BLOCK_TOKENS = 1 << 18
BLOCKS = "part int, block int, doc_ids array<bigint>, sizes array<bigint>, n_tokens bigint"


class WordEncoder:
    """Ids of texts by a tokenizers file, word by word."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        # Between added tokens, what lower case makes look like one is ordinary text.
        self.tokenizer.encode_special_tokens = True
        # Added tokens are found in a text as it is, also inside a word; texts are cut there.
        special = {t["content"].encode(): t["id"] for t in json.loads(content).get("added_tokens", [])}
        self.special = {text: array("H", [number]).tobytes() for text, number in special.items()}
        longest_first = sorted(map(re.escape, special), key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(longest_first) + b")").split if special else None
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.splits_plainly = sys.byteorder == "little" and all(
            self._ids(text.decode()) == [t.id for part in PARTS(text) for t in self.tokenizer.model.tokenize(part.decode())]
            for text in (b"it's", b"a1,b", b"we're", b"x''s", b"(abc)...12", b"i'm'll'd", b"-_-")
        )
        # A character that is a token of its own between spaces marks where a word ends.
        marks = ((c, self._ids(c)) for c in MARKS)
        self.mark, self.mark_id = next(((c, ids[0]) for c, ids in marks if len(ids) == 1), (None, None))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[bytes]) -> None:
        """Encode words in one text, which costs far less than one call each, and cut its ids."""
        texts = [w.decode() for w in words]
        if self.mark is None or self.mark in "".join(texts):
            for word, text in zip(words, texts, strict=True):
                self.cache[word] = np.array(self._ids(text), "<u2").tobytes()
            return
        ids = np.array(self._ids(f" {self.mark} ".join(texts)), "<u2")
        cuts = np.flatnonzero(ids == self.mark_id).tolist()
        raw = ids.tobytes()
        for word, start, end in zip(words, [-1, *cuts], [*cuts, len(ids)], strict=True):
            self.cache[word] = raw[2 * start + 2 : 2 * end]

    def encode(self, blobs: list[bytes]) -> list[bytes]:
        """Ids of each text, two bytes each."""
        pieces, cut_texts = blobs, {}
        for at, blob in enumerate(blobs):
            if self.cut is not None and any(text in blob for text in self.special):
                cut_texts[at] = self.cut(blob)
        if cut_texts:
            pieces = [b if at not in cut_texts else b"" for at, b in enumerate(blobs)]
        out = self._encode_words(pieces)
        for at, parts in cut_texts.items():  # text, added token, text, ...
            coded = self._encode_words(parts[::2])
            added = [self.special[text] for text in parts[1::2]] + [b""]
            out[at] = b"".join(x for pair in zip(coded, added, strict=True) for x in pair)
        return out

    def _encode_words(self, blobs: list[bytes]) -> list[bytes]:
        lists = [blob.lower().split() for blob in blobs]  # the tokenizer ignores case
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        new = set().union(*lists).difference(self.cache)
        known = new.intersection(self.older)
        self.cache.update((word, self.older[word]) for word in known)
        rest = list(new - known)
        if self.splits_plainly:
            rest = self._learn_plain(rest)
        for start in range(0, len(rest), 2048):
            self._learn(rest[start : start + 2048])
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in lists]

    def _learn_plain(self, words: list[bytes]) -> list[bytes]:
        """Encode the words that only need splitting before the merges; the others come back."""
        rest, tokenize, parts = [], self.tokenizer.model.tokenize, self.parts
        if len(parts) > CACHE_WORDS:
            parts.clear()
        for word in words:
            if not PLAIN(word):
                rest.append(word)
                continue
            coded = b""
            for part in PARTS(word):
                ids = parts.get(part)
                if ids is None:
                    found = [token.id for token in tokenize(part.decode())]
                    ids = parts[part] = array("H", found).tobytes()
                coded += ids
            self.cache[word] = coded
        return rest


class WordTokenizer:
    """The tokenizer file as it travels with the query; ids must be below 65,536."""

    def __init__(self, path: str):
        self.content = Path(path).read_text(encoding="utf-8")

    def encoder(self) -> WordEncoder:
        key = hashlib.sha256(self.content.encode()).hexdigest()
        return kept(("words", key), lambda: WordEncoder(self.content))


def _encoded(tokenizer: WordTokenizer, end_id: int) -> Callable:
    """Ids of each text, where the text is read."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.encoder()
        for batch in batches:
            blobs = as_bytes(batch["text"])
            for start, stop in chunks(blobs, 1 << 20):
                coded = [ids + end for ids in encoder.encode(blobs[start:stop])]
                some = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"], some["h"], pa.array(coded, pa.binary())], names=["doc_id", "h", "ids"]
                )

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for blob in batch["ids"].to_pylist():
            ids = np.frombuffer(blob, "<u2")
            if len(ids) < 1 << 12:
                np.add.at(counts, ids, 1)
            else:
                counts += np.bincount(ids, minlength=1 << 16)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"symbol": pa.array(used, pa.int32()), "n": pa.array(counts[used])})


def _blocks(freq: np.ndarray) -> Callable:
    """Coded blocks of whole documents, in the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, number = Table(freq), TaskContext.get().partitionId(), 0
        names, sizes, held, total = [], [], [], 0

        def block() -> pa.RecordBatch:
            coded = encode_block(np.frombuffer(b"".join(held), "<u2"), table)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([number], pa.int32()),
                    "doc_ids": pa.array([names], pa.list_(pa.int64())),
                    "sizes": pa.array([sizes], pa.list_(pa.int64())),
                    "n_tokens": pa.array([total], pa.int64()),
                    "payload": pa.array([coded], pa.binary()),
                }
            )

        for batch in batches:
            for name, ids in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                names.append(name), held.append(ids), sizes.append(len(ids) // 2)
                total += len(ids) // 2
                if total >= BLOCK_TOKENS:
                    yield block()
                    number += 1
                    names, sizes, held, total = [], [], [], 0
        if names:
            yield block()

    return run


def write_files(docs: DataFrame, path: str, tokenizer: WordTokenizer, end_id: int = 1) -> None:
    """Write the file set of ``docs`` (doc_id, text) to ``path``.

    Texts are encoded where they are read; what is ordered and shuffled is their ids.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    encoded = written(rows.mapInArrow(_encoded(tokenizer, end_id), "doc_id long, h long, ids binary"), "ids")
    counts = np.zeros(1 << 16, np.int64)
    summed = encoded.select("ids").mapInArrow(_count, "symbol int, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # at most 65,536 rows
        counts[row["symbol"]] = row["n"]
    freq = quantise(counts)
    spark = docs.sparkSession
    used = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(used, "symbol int, freq int").coalesce(1).write.parquet(f"{path}/table")
    order = (F.col("doc_id").asc_nulls_first(), F.col("h"))
    ordered = encoded.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    ordered.mapInArrow(_blocks(freq), f"{BLOCKS}, payload binary").write.parquet(f"{path}/blocks")


def _decode(freq: np.ndarray, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["payload"], table)
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                parts = [ids[a:b] for a, b in zip(ends - sizes, ends, strict=True)]
                columns = {
                    "part": pa.array([row["part"]] * len(parts), pa.int32()),
                    "block": pa.array([row["block"]] * len(parts), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "offset": pa.array(ends - sizes),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([crc_of(p) for p in parts], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(parts, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document of a file set."""
    freq = np.zeros(1 << 16, np.uint32)
    for row in spark.read.parquet(f"{path}/table").collect():  # at most 65,536 rows
        freq[row["symbol"]] = row["freq"]
    schema = f"{BLOCKS}, payload binary"
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
    # Where a block starts: ids of earlier parts, then of earlier blocks of its part.
    sizes = blocks.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = parts.select("part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_parts"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select(
        "part",
        "block",
        (F.col("_parts") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("_start"),
    )
    out = "part int, block int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"
    decoded = blocks.select("part", "block", "doc_ids", "sizes", "payload").mapInArrow(
        _decode(freq, with_ids), out + (", ids array<int>" if with_ids else "")
    )
    return decoded.join(starts, ["part", "block"]).select(
        "doc_id",
        (F.col("_start") + F.col("offset")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def written_and_read(docs: DataFrame, tokenizer: WordTokenizer, end_id: int = 1) -> DataFrame:
    """The documents' places and checksums, read back from files in the shared folder."""
    path = new_path(docs.sparkSession, "tokens")
    write_files(docs, path, tokenizer, end_id)
    return read_files(docs.sparkSession, path)
