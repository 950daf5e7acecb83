"""Byte-level BPE by a rank file: texts to ids and back.

Each match of the pattern is encoded on its own. A match that is a token is that
token; else the pair of neighbouring parts with the least rank, the leftmost
among equals, is merged until no pair has a rank. A segment tree over the byte
positions holds the least (rank, position) of each range; a merge changes three
leaves - the merged part, its left neighbour, and the part that vanished - and
their ancestors, so a match of m bytes takes O(m log m), however long it is.

The matches of a batch that are met for the first time are merged together: one row a
match in arrays of bytes, ids and trees, so a round pops the root of every row and
updates the logarithm of its size in cells. A pair of ids finds its rank in a sorted table
of all ways to cut a token into two tokens. Matches of more than ``ROW_BYTES`` bytes have
a tree of their own.

Encoded matches are kept per Python worker, in two generations of a fixed number each.
Ranks and pattern travel with the query; executors read no files.

Edge cases: a null text counts as empty; an empty text has no ids and decodes to
no bytes. Rows are independent: repeated rows and null ids are encoded like any
others. No rows give no rows; columns other than doc_id and text are not read, whatever
their names. Lone surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotledger.llm.words import as_bytes
from slotledger.llm.workers import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHE_ENTRIES = 100_000  # of each generation
CHUNK_CHARS = 1 << 20  # of text that is split before its new matches are merged
ROW_BYTES, ROWS = 64, 1 << 14  # longest match of a row, rows merged together
ROW_BITS, ID_BITS = 6, 24
NONE = 1 << 62
SHIFT = 32


class Vocabulary:
    """Ranks of a rank file (a base64 token and its rank on each line) with a splitting pattern."""

    def __init__(self, content: bytes, pattern: str):
        lines = (line.split() for line in content.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        # Ids of a match, four bytes each, and as decimals with spaces: newer and older matches.
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self._tables()

    def _tables(self) -> None:
        """Arrays for merging many matches: ids of bytes, and ranks of pairs of ids."""
        get = self.ranks.get
        self.byte_ids = np.array([get(bytes([b]), 0) for b in range(256)], np.int64)
        pairs = [
            (left << ID_BITS | right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := get(token[:cut])) is not None and (right := get(token[cut:])) is not None
        ]
        found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_keys = np.append(found[:, 0], NONE)
        self.pair_ranks = np.append(found[:, 1], NONE >> ID_BITS)
        self.names = {rank: str(rank).encode() for rank in self.tokens}
        self.whole_bytes = all(bytes([b]) in self.ranks for b in range(256))

    def _pair_values(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of pairs of ids that start at ``at``; NONE where the pair is no token."""
        key = left << ID_BITS | right
        place = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[place] == key, self.pair_ranks[place] << ROW_BITS | at, NONE)

    def merge_rows(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of 2 to ``size`` bytes, one after the other, and where each match's end.

        ``size`` is a power of two, ``ROW_BYTES`` at most.
        """
        m = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, m)
        padded = b"".join([p.ljust(size, b"\0") for p in pieces])
        ids = self.byte_ids[np.frombuffer(padded, np.uint8).reshape(m, size)]
        place = np.arange(size)
        alive = place < n[:, None]
        ends = np.broadcast_to(place + 1, (m, size)).copy()
        before = np.broadcast_to(place - 1, (m, size)).copy()
        tree = np.full((m, 2 * size), NONE, np.int64)
        first = self._pair_values(ids[:, :-1], ids[:, 1:], place[:-1])
        tree[:, size : 2 * size - 1] = np.where(alive[:, 1:], first, NONE)
        low = size
        while low > 1:  # a level of the trees from the one below
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        rows = np.arange(m)
        while True:
            root = tree[rows, 1]
            rows, root = rows[root != NONE], root[root != NONE]
            if not len(rows):
                break
            i = root & (ROW_BYTES - 1)
            gone = ends[rows, i]
            after = ends[rows, gone]
            ids[rows, i] = root >> ROW_BITS
            ends[rows, i], alive[rows, gone] = after, False
            more = after < n[rows]
            before[rows[more], after[more]] = i[more]
            behind = np.minimum(after, size - 1)
            value = np.where(more, self._pair_values(ids[rows, i], ids[rows, behind], i), NONE)
            back = before[rows, i]
            led = back >= 0
            prior = np.where(led, back, i)  # without a left neighbour the leaf itself again
            led_value = np.where(led, self._pair_values(ids[rows, prior], ids[rows, i], prior), value)
            tree[rows, size + gone] = NONE
            tree[rows, size + i] = value
            tree[rows, size + prior] = led_value
            every, node = np.concatenate([rows, rows, rows]), np.concatenate([gone, i, prior]) + size
            while node[0] > 1:
                node = node >> 1
                tree[every, node] = np.minimum(tree[every, 2 * node], tree[every, 2 * node + 1])
        return ids[alive], np.cumsum(alive.sum(axis=1))

    def _learn(self, matches: list[str]) -> None:
        """Put the ids of new matches into the cache."""
        groups: dict[int, tuple[list[str], list[bytes]]] = {}
        whole, tokens, ranks = self.ranks.get, [], []
        for match in matches:
            piece = match.encode()
            rank = whole(piece)
            if rank is not None:
                tokens.append(match)
                ranks.append(rank)
            elif len(piece) > ROW_BYTES or not self.whole_bytes:
                ids = self.merge(piece)
                self._keep([match], np.array(ids, np.int64), [len(ids)])
            else:
                size = 1 << (len(piece) - 1).bit_length()
                if size not in groups:
                    groups[size] = [], []
                held, pieces = groups[size]
                held.append(match)
                pieces.append(piece)
        self._keep(tokens, np.array(ranks, np.int64), list(range(1, len(ranks) + 1)))
        for size, (held, pieces) in groups.items():
            for start in range(0, len(held), ROWS):
                ids, ends = self.merge_rows(pieces[start : start + ROWS], size)
                self._keep(held[start : start + ROWS], ids, ends.tolist())

    def _keep(self, matches: list[str], ids: np.ndarray, ends: list[int]) -> None:
        """Cache the ids of some matches, which stand one after the other."""
        raw, names, cache, start = ids.astype("<u4").tobytes(), self.names, self.cache, 0
        decimals = [names[i] for i in ids.tolist()]
        for match, end in zip(matches, ends, strict=True):
            cache[match] = raw[4 * start : 4 * end], b" ".join(decimals[start:end])
            start = end

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n < 2:
            return [ranks[piece]] if n else []
        size = 1 << (n - 1).bit_length()
        # Leaf i: the pair that starts at byte i; ends[i] is where the part at i ends.
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << SHIFT | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        ends = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            if tree[k] == value:
                return
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low
                k >>= 1

        def pair(i: int) -> int:
            middle = ends[i]
            if middle >= n:
                return NONE
            rank = ranks.get(piece[i : ends[middle]])
            return NONE if rank is None else rank << SHIFT | i

        while tree[1] != NONE:
            i = tree[1] & ((1 << SHIFT) - 1)
            gone = ends[i]
            ends[i] = ends[gone]
            if ends[i] < n:
                before[ends[i]] = i
            put(gone, NONE)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def coded(self, texts: list[str]) -> Iterator[list[tuple[bytes, bytes]]]:
        """Ids of each match of each text, as the cache holds them."""
        start, chars = 0, 0
        for stop, text in enumerate(texts, 1):
            chars += len(text)
            if chars >= CHUNK_CHARS or stop == len(texts):
                yield from self._coded(texts[start:stop])
                start, chars = stop, 0

    def _coded(self, texts: list[str]) -> Iterator[list[tuple[bytes, bytes]]]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache, self.older = {}, self.cache
        lists = [self.split(text) for text in texts]
        new = set().union(*lists).difference(self.cache)
        known = new.intersection(self.older)
        self.cache.update((match, self.older[match]) for match in known)
        self._learn(list(new - known))
        get = self.cache.__getitem__
        for matches in lists:
            yield list(map(get, matches))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return [array("I", b"".join([ids for ids, _ in parts])).tolist() for parts in self.coded(texts)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Tokenizer:
    """Vocabulary as it travels: the file's content and the pattern."""

    def __init__(self, path: str, pattern: str):
        self.content, self.pattern = Path(path).read_bytes(), pattern

    def vocabulary(self) -> Vocabulary:
        key = hashlib.sha256(self.content + self.pattern.encode()).hexdigest()
        return kept(("bpe", key), lambda: Vocabulary(self.content, self.pattern))


def encode(text: Column, tokenizer: Tokenizer) -> Column:
    """Ids of each text as an array."""

    def run(texts: pa.Array) -> pa.Array:
        vocabulary = tokenizer.vocabulary()
        ids = vocabulary.encode_all([b.decode() for b in as_bytes(texts)])
        return pa.array(ids, pa.list_(pa.int32()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(text)


def decode(ids: Column, tokenizer: Tokenizer) -> Column:
    """Bytes of each array of ids; null has none."""

    def run(arrays: pa.Array) -> pa.Array:
        vocabulary = tokenizer.vocabulary()
        return pa.array([vocabulary.decode(x or ()) for x in arrays.to_pylist()], pa.binary())

    return F.arrow_udf(run, T.BinaryType())(ids)


DIGEST = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def round_trip(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id with the number and hash of its ids and the hash of what they decode to.

    Ids and bytes are hashed where they arise, so neither travels.
    """

    def run(texts: pa.Array) -> pa.Array:
        vocabulary = tokenizer.vocabulary()
        rows = []
        for parts in vocabulary.coded([blob.decode() for blob in as_bytes(texts)]):
            ids = array("I", b"".join([coded for coded, _ in parts]))
            written = b" ".join([decimals for _, decimals in parts])
            rows.append(
                (
                    len(ids),
                    hashlib.sha256(written).hexdigest(),
                    hashlib.sha256(vocabulary.decode(ids)).hexdigest(),
                )
            )
        n, sent, back = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(sent, pa.string()), pa.array(back, pa.string())],
            names=DIGEST.names,
        )

    out = docs.select("doc_id", F.arrow_udf(run, DIGEST)(F.col("text").cast("string")).alias("_digest"))
    return out.select("doc_id", "_digest.*")

