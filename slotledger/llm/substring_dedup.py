"""Repeated passages across documents: seed, extend, remove all but the first.

Seeds are k-grams of words chosen by winnowing: of the k-grams of each window of
``length`` words the one with the least hash, the leftmost among equals. Two
equal windows choose the same seed at the same offset, so seeds alone decide
which windows can be equal. Seeds meet by hash; each brings the hashes of the
windows that chose it, i.e. of its extensions to both sides up to the length. A
window is removed unless its first occurrence (by id, then start) is itself; runs
of such windows are the maximal repeats. Words that a removed window covers go.

Before the shuffle each task keeps only the first occurrence of a window among
its own, so however often a passage occurs, a task sends it once. A window is
told apart by the 64 bits of its seed's hash together with 48 bits of its own,
compared in full.

A hot seed (a phrase of 6 to 19 words in very many documents, each time with other
neighbours) does not gather its windows. A task that sees it often sends its windows
by their own hash, and its name to the seed's bucket; there, and where a bucket
outgrows its bound, all windows of the seed are passed on by their own hash. They meet
in a second round, in which equal windows are still together.

Edge cases: a null or empty text has no words; fewer words than the length are
never removed. Null ids come after all others. Rows with one id are ordered by
the CRC of their text; rows equal in id and text count once, do not remove each
other and get equal results, unless a passage is repeated within them. Columns other than
id and text are not read.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotledger.llm.filters import maybe_in
from slotledger.llm.scratch import written
from slotledger.llm.words import Words, as_bytes, chunks, grams, mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAST = (1 << 63) - 1  # stands for a null id


@dataclass(frozen=True)
class Settings:
    length: int = 20
    seed: int = 6  # words of a seed; at most 16 seeds to a window
    flush_windows: int = 1 << 19  # windows a map task holds
    bucket_windows: int = 1 << 19  # windows that meet in one task, about
    hot_runs: int = 64  # occurrences of a seed among a task's windows from which it is hot
    bucket_bound: int = 1 << 22  # windows a bucket holds; beyond, its largest seeds go on


#: A seed occurrence: hash, document, place of the seed, and which windows it brings
#: (bit o: the window that starts o words before the seed).
RUN = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("crc", "<u4"), ("at", "<u4"), ("mask", "<u2")])
#: What a row brings: runs of windows; runs with removed windows; windows of hot seeds,
#: placed by their own hash; hot seeds.
RUNS, HITS, SINGLE, HOT = range(4)
SENT = "bucket long, kind int, runs binary, own binary"
HIT = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("at", "<u4"), ("mask", "<u2")])


def windows_of(blobs: list[bytes], cut: Settings) -> tuple[np.ndarray, ...]:
    """Text, start, offset of the seed, seed hash and own hash of every window."""
    words = Words(blobs)
    span = cut.length - cut.seed + 1
    starts = np.flatnonzero(words.fits(cut.length))
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    keys = words.hashes()
    seeds = grams(keys, cut.seed)
    least, size = seeds, 1
    while size * 2 <= span:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    low = np.minimum(least[starts], least[starts + span - size])
    offset = np.zeros(len(starts), np.int64)
    for o in range(span - 1, -1, -1):
        offset[seeds[starts + o] == low] = o
    document = words.documents()[starts]
    own = grams(keys, cut.length)[starts]
    return document, starts - words.starts[document], offset, low, own


def _keys(seed: np.ndarray, own: np.ndarray) -> np.ndarray:
    return mix(seed ^ ((own >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)))


def _not_first(
    seed: np.ndarray, own: np.ndarray, order: tuple[np.ndarray, ...]
) -> tuple[np.ndarray, np.ndarray]:
    """Which windows occur at an earlier place too (``order``: most significant first), and
    which come again from the same place."""
    keys, own = _keys(seed, own), own >> np.uint64(16)
    later, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    by_key = np.argsort(keys, kind="stable")
    same = keys[by_key][1:] == keys[by_key][:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    few = by_key[shared]
    if not len(few):
        return later, again
    # Equal mixed keys only bring windows together: both hashes decide.
    rank = np.lexsort((*(c[few] for c in order[::-1]), own[few], seed[few]))
    few = few[rank]
    columns = [c[few] for c in order]
    differ = (seed[few][1:] != seed[few][:-1]) | (own[few][1:] != own[few][:-1])
    first = np.flatnonzero(np.concatenate([[True], differ]))
    first = first[np.cumsum(np.concatenate([[True], differ])) - 1]
    later[few] = np.any([c != c[first] for c in columns], axis=0)
    moved = differ | np.any([c[1:] != c[:-1] for c in columns], axis=0)
    again[few[1:]] = ~moved
    return later, again


def _packed(doc, crc, start, offset, seed, own, kind) -> tuple[np.ndarray, np.ndarray]:
    """Windows in place order as runs of one seed occurrence, and the windows' hashes (48 bits).

    Starts rise within a run: a repeated row begins runs of its own, so each window has its bit.
    """
    at = start + offset
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]) | (start[1:] <= start[:-1])
    first = np.flatnonzero(new)
    runs = np.empty(len(first), kind)
    for name, values in (("doc", doc), ("crc", crc), ("at", at), ("seed", seed)):
        if name in kind.names:
            runs[name] = values[first]
    runs["mask"] = np.bitwise_or.reduceat(np.left_shift(1, offset).astype(np.uint16), first) if len(first) else 0
    six = own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return runs, np.ascontiguousarray(six)


def _batch(kind: int, buckets: list[int], runs: list[bytes], own: list[bytes] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(buckets, pa.int64()),
            "kind": pa.array([kind] * len(buckets), pa.int32()),
            "runs": pa.array(runs, pa.binary()),
            "own": pa.array(own or [b""] * len(buckets), pa.binary()),
        }
    )


def _place(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(buckets)).astype(np.int64)


def _sizes(runs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(runs["mask"]).astype(np.int64)


def _dealt(kind: int, place: np.ndarray, runs: np.ndarray, six: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs and the hashes of their windows, a row a bucket."""
    if not len(runs):
        return
    sizes = _sizes(runs)
    order = np.argsort(place, kind="stable")
    # Hashes follow their runs into the bucket.
    begin = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    ends = np.cumsum(size)
    index = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
    six, runs, place = six[index], runs[order], place[order]
    heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    stops = np.append(heads[1:], len(place)).astype(np.int64)
    upto = np.concatenate([[0], ends])
    for i in range(0, len(heads), 1024):
        pairs = list(zip(heads[i : i + 1024], stops[i : i + 1024], strict=True))
        yield _batch(
            kind, [int(place[a]) for a, _ in pairs],
            [runs[a:b].tobytes() for a, b in pairs],
            [six[upto[a] : upto[b]].tobytes() for a, b in pairs],
        )


def _own(six: np.ndarray) -> np.ndarray:
    """Hashes of windows (48 bits, above 16 zeros)."""
    own = np.zeros((len(six), 8), np.uint8)
    own[:, 2:] = six
    return own.reshape(-1).view("<u8")


def _windows(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of each window and its offset; windows of a run come with falling offset: starts rise."""
    bits = (runs["mask"][:, None] >> np.arange(15, -1, -1, dtype=np.uint16)) & 1
    which, column = np.nonzero(bits)
    return which, 15 - column


def _singles(runs: np.ndarray, six: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each window as a run of its own, placed by its own hash."""
    which, offset = _windows(runs)
    each = runs[which]
    each["mask"] = np.left_shift(1, offset).astype(np.uint16)
    yield from _dealt(SINGLE, _place(_keys(each["seed"], _own(six)), buckets), each, six)


def _seeds(cut: Settings, buckets: int) -> Callable:
    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, crc, start, offset, seed, own = map(np.concatenate, zip(*held, strict=True))
        later, again = _not_first(seed, own, (doc, crc, start))
        lost = later & ~again
        if lost.any():
            hits, _ = _packed(*(x[lost] for x in (doc, crc, start, offset, seed, own)), HIT)
            parts = [hits[i : i + 8192] for i in range(0, len(hits), 8192)]
            places = [int(_place(p["doc"][:1].astype(np.uint64), buckets)[0]) for p in parts]
            yield _batch(HITS, places, [p.tobytes() for p in parts])
        rest = ~(later | again)
        runs, six = _packed(*(x[rest] for x in (doc, crc, start, offset, seed, own)), RUN)
        sizes = _sizes(runs)
        if sizes.sum() != len(six):
            raise ValueError(f"runs of {sizes.sum()} windows have {len(six)} hashes")
        names, times = np.unique(runs["seed"], return_counts=True)
        names = names[times >= cut.hot_runs]
        if len(names):
            hot = np.isin(runs["seed"], names)
            yield _batch(HOT, _place(names, buckets).tolist(), [n.tobytes() for n in names])
            yield from _singles(runs[hot], six[np.repeat(hot, sizes)], buckets)
            runs, six = runs[~hot], six[np.repeat(~hot, sizes)]
        yield from _dealt(RUNS, _place(runs["seed"], buckets), runs, six)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            blobs = as_bytes(batch["text"])
            ids = batch["doc"].to_numpy(zero_copy_only=False)
            for begin, end in chunks(blobs):
                part = blobs[begin:end]
                crcs = np.fromiter(map(zlib.crc32, part), np.uint32, len(part))
                document, start, offset, seed, own = windows_of(part, cut)
                held.append((ids[begin:end][document], crcs[document], start, offset, seed, own))
                size += len(start)
                if size >= cut.flush_windows:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    return run


def _removed(runs: np.ndarray, six: np.ndarray) -> np.ndarray:
    """Seed occurrences with the windows they lose, among those that meet."""
    which, offset = _windows(runs)
    each = runs[which]
    later, _ = _not_first(
        each["seed"], _own(six), (each["doc"], each["crc"], each["at"].astype(np.int64) - offset)
    )
    mask = np.zeros(len(runs), np.uint16)
    np.bitwise_or.at(mask, which[later], np.left_shift(1, offset[later]).astype(np.uint16))
    some = mask > 0
    hits = np.empty(int(some.sum()), HIT)
    for name in ("doc", "crc", "at"):
        hits[name] = runs[name][some]
    hits["mask"] = mask[some]
    return hits


def _parts(hits: np.ndarray) -> Iterator[np.ndarray]:
    return (hits[i : i + (1 << 16)] for i in range(0, len(hits), 1 << 16))


def _meet_seeds(cut: Settings, buckets: int) -> Callable:
    """First round: windows of one seed meet; those of hot seeds go on to meet by their own hash."""

    def largest(runs: np.ndarray) -> np.ndarray:
        """The largest seeds that leave half of the bound when they go."""
        names, at = np.unique(runs["seed"], return_inverse=True)
        windows = np.bincount(at, _sizes(runs), len(names))
        order = np.argsort(-windows, kind="stable")
        left = windows.sum() - np.cumsum(windows[order])
        return names[order[: int(np.argmax(left <= cut.bucket_bound / 2)) + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes, size = [], [], 0
        hot = np.empty(0, np.uint64)
        place = 0

        def settle(full: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, hashes, size, hot
            runs, six = np.concatenate(held), np.concatenate(hashes)
            sizes = _sizes(runs)
            gone = np.isin(runs["seed"], hot)
            if not full and sizes[~gone].sum() > cut.bucket_bound / 2:
                hot = np.union1d(hot, largest(runs[~gone]))
                gone = np.isin(runs["seed"], hot)
            yield from _singles(runs[gone], six[np.repeat(gone, sizes)], buckets)
            held, hashes = [runs[~gone]], [six[np.repeat(~gone, sizes)]]
            size = len(hashes[0])

        for batch in batches:
            through = np.isin(batch["kind"].to_numpy(), (HITS, SINGLE))
            if through.any():
                yield batch.filter(pa.array(through))
                batch = batch.filter(pa.array(~through))
            rows = zip(*(batch[n].to_pylist() for n in ("bucket", "kind", "runs", "own")), strict=True)
            for place, kind, runs, own in rows:
                if kind == HOT:
                    hot = np.union1d(hot, np.frombuffer(runs, np.uint64))
                else:
                    held.append(np.frombuffer(runs, RUN))
                    hashes.append(np.frombuffer(own, np.uint8).reshape(-1, 6))
                    size += len(hashes[-1])
                if size > cut.bucket_bound:
                    yield from settle(full=False)
        if held:
            yield from settle(full=True)
            for hits in _parts(_removed(held[0], hashes[0])):
                yield _batch(HITS, [place], [hits.tobytes()])

    return run


def _meet_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second round: all seed occurrences that lose windows, in rows of their own."""

    def unpacked(hits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "doc": pa.array(hits["doc"]),
                "crc": pa.array(hits["crc"].astype(np.int64)),
                "at": pa.array(hits["at"].astype(np.int64)),
                "mask": pa.array(hits["mask"].astype(np.int32)),
            }
        )

    held, hashes = [], []
    for batch in batches:
        for kind, runs, own in zip(*(batch[n].to_pylist() for n in ("kind", "runs", "own")), strict=True):
            if kind == HITS:
                yield unpacked(np.frombuffer(runs, HIT))
            else:
                held.append(np.frombuffer(runs, RUN))
                hashes.append(np.frombuffer(own, np.uint8).reshape(-1, 6))
    if held:
        for hits in _parts(_removed(np.concatenate(held), np.concatenate(hashes))):
            yield unpacked(hits)


def covered(n: int, at: np.ndarray, mask: np.ndarray, length: int) -> np.ndarray:
    """Words that the windows of some seed occurrences cover."""
    bits = (np.asarray(mask)[:, None] >> np.arange(16)) & 1
    which, offset = np.nonzero(bits)
    start = np.asarray(at)[which] - offset
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def _shorten(length: int, with_text: bool) -> Callable:
    def run(texts: pa.Array, at: pa.Array, mask: pa.Array) -> pa.Array:
        rows = []
        for blob, a, m in zip(as_bytes(texts), at.to_pylist(), mask.to_pylist(), strict=True):
            words = blob.split()
            gone = 0
            if a:
                lost = covered(len(words), np.array(a), np.array(m), length)
                gone = int(lost.sum())
                words = [words[i] for i in np.flatnonzero(~lost)]
            kept = b" ".join(words)
            rows.append(
                (len(words) + gone, gone, kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest())
            )
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
            names=RESULT.names,
        )

    return run


def repeated_windows(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc, crc, at, mask``: arrays of seed occurrences with removed windows, for each document
    that loses some (``doc``: its id, or the last number for null; ``crc``: of its text)."""
    cut = settings or Settings()
    if not 0 < cut.length - cut.seed + 1 <= 16:
        raise ValueError("a window must hold 1 to 16 seeds")
    text = F.col("text").cast("string")
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text.alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(8, int(size / 7 // cut.bucket_windows) + 1)
    hits = (
        source.mapInArrow(_seeds(cut, buckets), SENT)
        .groupBy("bucket")
        .applyInArrow(_meet_seeds(cut, buckets), SENT)
        .groupBy("bucket")
        .applyInArrow(_meet_windows, "doc long, crc long, at long, mask int")
    )
    # A set: rows equal in id and text bring equal entries. It grows with one text's seeds.
    packed = F.collect_set(F.shiftleft("at", 16).bitwiseOR(F.col("mask").cast("long")))
    return hits.groupBy("doc", "crc").agg(packed.alias("hits")).select(
        "doc", "crc",
        F.transform("hits", lambda h: F.shiftright(h, 16)).alias("at"),
        F.transform("hits", lambda h: h.bitwiseAND(F.lit(0xFFFF)).cast("int")).alias("mask"),
    )


def remove_repeats(
    docs: DataFrame, settings: Settings | None = None, with_text: bool = False
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) of every row of ``docs``."""
    cut = settings or Settings()
    text = F.col("text").cast("string")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        text.alias("text"),
    )
    none = F.lit(None)
    shorten = F.arrow_udf(_shorten(cut.length, with_text), RESULT)
    found = written(repeated_windows(docs, cut), "repeats")
    # Texts that lose nothing are hashed where they are read; only the others are shuffled.
    lost = maybe_in(rows, found.select("doc"), "doc").join(found, ["doc", "crc"])
    lost = lost.select("doc", "crc", shorten("text", "at", "mask").alias("lost")).dropDuplicates(["doc", "crc"])
    whole = rows.select(
        "doc_id", "doc", "crc",
        shorten(F.col("text"), none.cast("array<long>"), none.cast("array<int>")).alias("whole"),
    )
    both = whole.join(lost, ["doc", "crc"], "left")
    one = lambda name: F.coalesce(F.col(f"lost.{name}"), F.col(f"whole.{name}")).alias(name)
    names = [n for n in RESULT.names if with_text or n != "kept_text"]
    return both.select("doc_id", *[one(n) for n in names])
