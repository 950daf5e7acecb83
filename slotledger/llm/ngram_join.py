"""Exact Jaccard join of word n-gram sets as a metric-space join.

1 - Jaccard is a metric, but unrelated documents all lie at distance 1 from each
other, so pivots taken at random tell nothing about most of them. The join
therefore works down in levels, each of which loses no pair within the radius:

1. Documents with equal sets are one class; only classes go on.
2. A pair within the radius shares one of the first ``n - ceil(t n) + 1`` shingles
   of either set in any common order. The order puts shingles that many documents
   hold last (counters of fixed size over all documents). Each shingle's least
   class is the pivot of a region; a class belongs to the region of every pivot
   that it may share such a shingle with.
3. Inside a region, sizes and parity sketches bound distances from below (both
   are contractions of the symmetric difference), which leaves few pairs.
   What they connect are the clusters that may hold links.
4. Inside a cluster distances are exact. Pivots are compared with all classes of
   the cluster by an inverted index; the triangle inequality restricts later
   pivots to classes within the radius of their distances, and pairs already
   connected need no comparison. A cluster too large for one task is split into
   Voronoi regions of its pivots; the classes that are not yet connected with its
   largest component are copied to every region that the window allows.

Links are reported as components, so copies are never expanded into pairs.

Edge cases: a text with fewer words than ``n`` is one shingle; a null text, an
empty text and one without words have an empty set, are linked with nothing and
get their own id. Ids may repeat: each row counts as a document, and rows with
one id share nothing but the id. Null ids take part, but are never the least id
unless a component has no other. Other columns are neither read nor returned.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.llm.filters import maybe_in
from slotledger.llm.graph import components
from slotledger.llm.scratch import written
from slotledger.llm.words import Words, as_bytes, grams, mix
from slotledger.llm.workers import release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTERS = 1 << 20
BLOCK = 1 << 12
#: UTF-8 bytes of texts that a Python worker holds as words at once.
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Similarity is ``percent`` / 100. The rest bounds memory and cuts work, never results."""

    n: int = 5
    percent: int = 80
    flush_entries: int = 1 << 20  # prefix entries that a map task holds
    bucket_entries: int = 1 << 18  # prefix entries that meet in one task, about
    local_run: int = 64  # classes of one shingle kept apart in a map task
    region_run: int = 512  # classes of one shingle compared by sketches
    cluster_shingles: int = 1 << 21  # shingles joined in one task
    pivots: int = 24


# ---------------------------------------------------------------- sets of texts


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of consecutive texts of at most ``PIECE_BYTES`` (or one text), with their bytes.

    Only one range at a time becomes Python objects, not the whole Arrow batch.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    start, size = 0, 0
    for at, n in enumerate(sizes):
        if size and size + n > PIECE_BYTES:
            yield start, at, as_bytes(texts[start:at])
            start, size = at, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes), as_bytes(texts[start:])


def shingle_sets(blobs: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, text of each, size of each text's set."""
    words = Words(blobs, lower=True)
    keys = words.hashes()
    document = words.documents()
    fits = words.fits(n)
    at = np.flatnonzero(fits)
    hashes, owner = grams(keys, n)[at], document[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = [grams(keys[words.starts[i] : words.ends[i]], int(words.counts[i]))[0] for i in short]
        hashes = np.concatenate([hashes, np.array(whole, np.uint64)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, owner, np.bincount(owner, minlength=len(blobs)).astype(np.int64)


def set_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits that equal sets share, as 16 bytes a set."""
    out = np.zeros((len(sizes), 2), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for i, salt in enumerate((0x1234567, 0xABCDEF987654321)):
            out[full, i] = mix(np.add.reduceat(mix(hashes ^ np.uint64(salt)), starts))
    return out.astype(">u8").view("V16").ravel()


def sketch_bits(size: int) -> int:
    return max(64, 1 << (max(int(size), 1) - 1).bit_length())


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the shingles that fall on i; two sets differ at least as often."""
    bits = sketch_bits(len(hashes))
    parity = np.bincount((hashes >> np.uint64(20)) & np.uint64(bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(bool), bitorder="little")


def _shapes(n: int) -> Callable:
    """Rows of documents (key, set size, sketch), and at the end of a task its shingle counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        used = False
        for batch in batches:
            for start, end, blobs in _pieces(batch["text"]):
                hashes, _, sizes = shingle_sets(blobs, n)
                counters += np.bincount(hashes & np.uint64(COUNTERS - 1), minlength=COUNTERS)
                used = True
                stops = np.cumsum(sizes)
                sketches = [
                    parity_sketch(hashes[a:b]).tobytes() if b > a else b""
                    for a, b in zip(stops - sizes, stops, strict=True)
                ]
                keys = set_keys(hashes, sizes)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"][start:end],
                        "address": batch["address"][start:end],
                        "tie": batch["tie"][start:end],
                        "key": pa.array([k.tobytes() for k in keys], pa.binary()),
                        "n": pa.array(sizes),
                        "sketch": pa.array(sketches, pa.binary()),
                        "block": pa.nulls(end - start, pa.int32()),
                    }
                )
        if used:
            blocks = counters.reshape(-1, BLOCK).astype("<i4")
            m = len(blocks)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.nulls(m, pa.int64()),
                    "address": pa.nulls(m, pa.string()),
                    "tie": pa.nulls(m, pa.int64()),
                    "key": pa.nulls(m, pa.binary()),
                    "n": pa.nulls(m, pa.int64()),
                    "sketch": pa.array([b.tobytes() for b in blocks], pa.binary()),
                    "block": pa.array(np.arange(m, dtype=np.int32)),
                }
            )
        counters = blocks = None
        release()

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, block = np.zeros(BLOCK, np.int64), 0
    for batch in batches:
        block = batch["block"][0].as_py()
        for blob in batch["sketch"].to_pylist():
            total += np.frombuffer(blob, "<i4")
    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "sums": [total.tobytes()]})


def _levels(shapes: DataFrame) -> np.ndarray:
    """Order class of each counter: 0, or the power of two of what it holds above the mean."""
    sums = (
        shapes.where("block IS NOT NULL")
        .select("block", "sketch")
        .groupBy("block")
        .applyInArrow(_sum_blocks, "block int, sums binary")
    )
    counts = np.zeros((COUNTERS // BLOCK, BLOCK), np.int64)
    for row in sums.collect():  # COUNTERS numbers, whatever the input
        counts[row["block"]] = np.frombuffer(row["sums"], np.int64)
    counts = counts.ravel()
    mean = counts.mean()
    above = np.maximum(counts - mean - 6 * np.sqrt(mean) - 16, 0)
    return np.where(above > 0, 4 + np.log2(above + 1), 0).astype(np.uint8)


# ------------------------------------------------------------------- regions

ENTRY = np.dtype([("s", "<u8"), ("key", "V16"), ("many", "?")])
EDGE = np.dtype([("p", "V16"), ("x", "V16")])


def _unique(rows: np.ndarray) -> np.ndarray:
    """Distinct rows of a structured array."""
    if len(rows) < 2:
        return rows
    return np.unique(rows.view(f"V{rows.dtype.itemsize}")).view(rows.dtype)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_values)))


def prefix_entries(blobs: list[bytes], cut: Settings, levels: np.ndarray) -> np.ndarray:
    hashes, owner, sizes = shingle_sets(blobs, cut.n)
    if not len(hashes):
        return np.empty(0, ENTRY)
    keys = set_keys(hashes, sizes)
    level = levels[hashes & np.uint64(COUNTERS - 1)]
    order = np.lexsort((hashes, level, owner))
    rank = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - (cut.percent * sizes + 99) // 100 + 1
    inside = rank < prefix[owner]
    out = np.empty(int(inside.sum()), ENTRY)
    out["s"] = hashes[order][inside]
    out["key"] = keys[owner[inside]]
    out["many"] = False
    return out


def _combine(entries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries without repeats; of a shingle with over ``limit`` classes the least stays, with edges to it."""
    entries = _unique(entries)
    entries = entries[np.argsort(entries["s"], kind="stable")]
    if not len(entries):
        return entries, np.empty(0, EDGE)
    starts, lengths = _runs(entries["s"])
    if lengths.max() <= limit:
        return entries, np.empty(0, EDGE)
    stay, edges = np.ones(len(entries), bool), []
    for start, length in zip(starts[lengths > limit], lengths[lengths > limit], strict=True):
        run = entries[start : start + length]
        low = np.argmin(_rank(run["key"]))
        stay[start : start + length] = False
        stay[start + low] = True
        entries["many"][start + low] = True
        edge = np.empty(length, EDGE)
        edge["p"], edge["x"] = run["key"][low], run["key"]
        edges.append(edge[edge["p"] != edge["x"]])
    return entries[stay], _unique(np.concatenate(edges))


def _rank(keys: np.ndarray) -> np.ndarray:
    """First 8 bytes of each key as a number: orders keys as bytes do, but for ties."""
    return np.frombuffer(keys.tobytes(), ">u8")[::2]


def _entries(cut: Settings, levels: np.ndarray, buckets: int) -> Callable:
    def pack(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows of the entries in ``held``, which it empties: a copy at a time is kept while sent."""
        entries = np.concatenate(held)
        held.clear()
        entries, edges = _combine(entries, cut.local_run)
        place = (mix(entries["s"]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        starts, lengths = _runs(place[order])
        blobs = [entries[order[a : a + k]].tobytes() for a, k in zip(starts, lengths, strict=True)]
        rows = {"bucket": place[order][starts], "sure": np.zeros(len(starts), bool)}
        del entries, place, order
        batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in rows.items()} | {"blob": blobs})
        del blobs, rows
        yield batch
        del batch
        if len(edges):
            spread = [edges[i : i + 4096] for i in range(0, len(edges), 4096)]
            where = [int(_rank(e["x"][:1])[0] % buckets) for e in spread]
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array(where, pa.int64()), "sure": [True] * len(spread), "blob": [e.tobytes() for e in spread]}
            )
        del edges
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, blobs in _pieces(batch["text"]):
                held.append(prefix_entries(blobs, cut, levels))
                size += len(held[-1])
                if size >= cut.flush_entries:
                    yield from pack(held)
                    held, size = [], 0
        if size:
            yield from pack(held)

    return run


def _edge_batch(edges: np.ndarray, sure: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "p": pa.array([k.tobytes() for k in edges["p"]], pa.binary()),
            "x": pa.array([k.tobytes() for k in edges["x"]], pa.binary()),
            "sure": pa.array(np.full(len(edges), sure)),
        }
    )


def _regions(cut: Settings) -> Callable:
    """Memberships (p, x) of the regions of one bucket's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for sure, blob in zip(batch["sure"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                if sure:
                    yield _edge_batch(np.frombuffer(blob, EDGE), True)
                else:
                    held.append(np.frombuffer(blob, ENTRY))
        if not held:
            return
        entries = _unique(np.concatenate(held))
        del held
        entries = entries[np.argsort(entries["s"], kind="stable")]
        starts, lengths = _runs(entries["s"])
        wide = np.repeat(lengths > 1, lengths)
        entries = entries[wide]
        if not len(entries):
            return
        starts, lengths = _runs(entries["s"])
        # The least class of each run stands first.
        order = np.lexsort((_rank(entries["key"]), entries["s"]))
        entries = entries[order]
        edges = np.empty(len(entries), EDGE)
        edges["p"] = np.repeat(entries["key"][starts], lengths)
        edges["x"] = entries["key"]
        sure = np.repeat((lengths > cut.region_run) | np.logical_or.reduceat(entries["many"], starts), lengths)
        for kind in (False, True):
            part = _unique(edges[sure == kind])
            for i in range(0, len(part), 1 << 16):
                yield _edge_batch(part[i : i + (1 << 16)], kind)

    return run


def fold(sketches: np.ndarray) -> np.ndarray:
    """Sketches of half as many bits."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


class _Sets:
    """Union-find over a few nodes."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        root = self.root
        while (root != root[root]).any():
            root = root[root]
        self.root = root
        return root


def near_by_sketch(sizes: np.ndarray, blobs: list[bytes], percent: int) -> np.ndarray:
    """Roots after joining every pair whose sketches allow the similarity."""
    sets = _Sets(len(sizes))
    widths = np.array([len(b) for b in blobs])
    at = {w: np.flatnonzero(widths == w) for w in np.unique(widths)}
    table = {w: np.array([np.frombuffer(blobs[i], np.uint8) for i in rows]) for w, rows in at.items()}
    for w, rows in at.items():
        own = table[w]
        # A set in the radius has at most 100 / percent as many shingles: twice the bits at most.
        others = [(rows, own)]
        if 2 * w in at:
            others.append((at[2 * w], fold(table[2 * w])))
        for i, row in enumerate(rows):
            for where, block in others:
                if where is rows:
                    where, block = where[i + 1 :], block[i + 1 :]
                low, high = np.minimum(sizes[row], sizes[where]), np.maximum(sizes[row], sizes[where])
                pick = np.flatnonzero(100 * low >= percent * high)
                for begin in range(0, len(pick), 2048):
                    few = pick[begin : begin + 2048]
                    differ = np.bitwise_count(block[few] ^ own[i]).sum(axis=1, dtype=np.int64)
                    both = sizes[row] + sizes[where[few]]
                    # |x and y| <= (|x| + |y| - differ) / 2, and the similarity needs that much.
                    near = (100 + percent) * (both - differ) >= 2 * percent * both
                    for j in where[few][near]:
                        sets.join(row, j)
    return sets.roots()


def _survivors(percent: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys, sizes = table["x"].to_pylist(), table["n"].to_numpy()
        roots = near_by_sketch(sizes, table["sketch"].to_pylist(), percent)
        apart = [i for i, r in enumerate(roots) if r != i]
        return pa.table(
            {
                "a": pa.array([keys[roots[i]] for i in apart], pa.binary()),
                "b": pa.array([keys[i] for i in apart], pa.binary()),
            }
        )

    return run


# ------------------------------------------------------------ exact distances


class Region:
    """Sets of some classes with an inverted index, for exact distances of one to all."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        values, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.owners = owner[np.argsort(self.ids, kind="stable")]
        self.begin = np.searchsorted(np.sort(self.ids), np.arange(len(values) + 1))
        self.stops = np.cumsum(self.sizes)
        self.values = values

    def shared_with(self, ids: np.ndarray) -> np.ndarray:
        """Shingles that each class shares with the set of those ids."""
        starts, lengths = self.begin[ids], self.begin[ids + 1] - self.begin[ids]
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
        return np.bincount(self.owners[where], minlength=len(self.sizes))

    def shared(self, i: int) -> np.ndarray:
        return self.shared_with(self.ids[self.stops[i] - self.sizes[i] : self.stops[i]])

    def shared_outside(self, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, values)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == values)]
        return self.shared_with(at)


def links_within(sets: list[np.ndarray], percent: int, pivots: int) -> np.ndarray:
    """Least row connected with each row by links; every pair is compared or excluded."""
    m = len(sets)
    found = _Sets(m)
    if m < 2:
        return found.roots()
    region = Region(sets)
    sizes = region.sizes
    open_ = np.ones(m, bool)  # not compared with all yet
    windows: list[np.ndarray] = []
    radius = 1 - percent / 100 + 1e-12
    for i in np.argsort(-sizes, kind="stable"):
        roots = found.roots()
        rest = open_ & (roots != roots[i])
        rest &= 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
        for distance in windows:
            if not rest.any():
                break
            rest &= np.abs(distance - distance[i]) <= radius
        open_[i] = False
        if not rest.any():
            continue
        inter = region.shared(i)
        union = sizes + sizes[i] - inter
        if len(windows) < pivots:
            windows.append(1 - inter / union)
        for j in np.flatnonzero(rest & (100 * inter >= percent * union)):
            found.join(int(i), int(j))
    return found.roots()


def _exact(cut: Settings) -> Callable:
    """(node, component) of the classes of one cluster."""

    def run(table: pa.Table) -> pa.Table:
        keys = table["key"].to_pylist()
        sets = [np.frombuffer(b, "<u8") for b in table["shingles"].to_pylist()]
        roots = links_within(sets, cut.percent, cut.pivots)
        low = {}
        for key, root in zip(keys, roots, strict=True):
            low[root] = min(key, low.get(root, key))
        return pa.table(
            {"node": pa.array(keys, pa.binary()), "component": pa.array([low[r] for r in roots], pa.binary())}
        )

    return run


def _to_pivots(cut: Settings) -> Callable:
    """Distances of the classes of one part of a large cluster to its pivots; edges to those in the radius."""

    def run(table: pa.Table) -> pa.Table:
        keys, pivot = table["key"].to_pylist(), np.array(table["pivot"].to_pylist(), bool)
        sets = [np.frombuffer(b, "<u8") for b in table["shingles"].to_pylist()]
        heads = sorted(np.flatnonzero(pivot), key=lambda i: keys[i])
        rows = np.flatnonzero(~pivot)
        if not len(rows):
            return _PIVOT_ROWS.empty_table()
        region = Region([sets[i] for i in rows])
        distance = np.empty((len(rows), len(heads)), np.float32)
        near = []
        for h, i in enumerate(heads):
            inter = region.shared_outside(sets[i])
            union = region.sizes + len(sets[i]) - inter
            distance[:, h] = 1 - inter / union
            near.append(100 * inter >= cut.percent * union)
        near = np.array(near).T
        linked = [[keys[heads[h]] for h in np.flatnonzero(row)] for row in near]
        return pa.table(
            {
                "cluster": pa.array([table["cluster"][0].as_py()] * len(rows), pa.binary()),
                "key": pa.array([keys[i] for i in rows], pa.binary()),
                "linked": pa.array(linked, pa.list_(pa.binary())),
                "distances": pa.array(list(distance), pa.list_(pa.float32())),
                "nearest": pa.array(distance.argmin(axis=1).astype(np.int32)),
            },
            schema=_PIVOT_ROWS,
        )

    return run


_PIVOT_ROWS = pa.schema(
    [
        ("cluster", pa.binary()),
        ("key", pa.binary()),
        ("linked", pa.list_(pa.binary())),
        ("distances", pa.list_(pa.float32())),
        ("nearest", pa.int32()),
    ]
)


def _across(cut: Settings) -> Callable:
    """Edges between the visitors of a part of a Voronoi region and its own classes."""

    def run(table: pa.Table) -> pa.Table:
        keys, visitor = table["key"].to_pylist(), np.array(table["visitor"].to_pylist(), bool)
        own = np.flatnonzero(~visitor)
        a, b = [], []
        if len(own):
            sets = [np.frombuffer(x, "<u8") for x in table["shingles"].to_pylist()]
            distance = np.array(table["distances"].to_pylist(), np.float32)
            region = Region([sets[i] for i in own])
            radius = 1 - cut.percent / 100 + 1e-5
            for i in np.flatnonzero(visitor):
                allowed = (np.abs(distance[own] - distance[i]) <= radius).all(axis=1)
                if not allowed.any():
                    continue
                inter = region.shared_outside(sets[i])
                union = region.sizes + len(sets[i]) - inter
                for j in np.flatnonzero(allowed & (100 * inter >= cut.percent * union)):
                    a.append(keys[i]), b.append(keys[own[j]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _large(members: DataFrame, sets: DataFrame, cut: Settings) -> DataFrame:
    """Edges among the classes of clusters too large for one task.

    ``members`` has cluster, key and ``parts``, the number of tasks a cluster needs.
    """
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    rows = written(
        members.join(sets, "key").select("cluster", "key", "parts", part.alias("part"), "shingles"), "large"
    )
    order = Window.partitionBy("cluster").orderBy("key")  # limited within each task before the shuffle
    picks = (
        rows.select("cluster", "key")
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= cut.pivots)
        .drop("_rank")
    )
    every_part = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
    pivots = rows.join(picks, ["cluster", "key"]).select(
        "cluster", "key", every_part.alias("part"), "shingles", F.lit(True).alias("pivot")
    )
    asked = rows.select("cluster", "key", "part", "shingles", F.lit(False).alias("pivot"))
    placed = (
        asked.unionByName(pivots)
        .groupBy("cluster", "part")
        .applyInArrow(
            _to_pivots(cut),
            "cluster binary, key binary, linked array<binary>, distances array<float>, nearest int",
        )
    )
    placed = written(placed, "placed")
    edges = placed.select(F.col("key").alias("a"), F.explode("linked").alias("b"))
    joined = components(edges).withColumnRenamed("node", "key")
    state = placed.drop("linked").join(joined, "key", "left")
    state = state.withColumn("component", F.coalesce("component", "key"))
    state = written(
        state.withColumn("own", F.element_at("distances", F.col("nearest") + 1)), "state"
    )
    main = (
        state.groupBy("cluster", "component")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("cluster")
        .agg(F.max_by("component", F.struct("_n", "component")).alias("main"))
    )
    # A Voronoi region is the classes nearest to one pivot, in parts of bounded size. A class
    # outside the largest component visits every region whose ring it may reach into.
    homes = state.join(rows.select("key", "part", "shingles"), "key")
    rings = state.join(rows.select("key", "part"), "key").groupBy("cluster", "nearest", "part").agg(
        F.min("own").alias("low"), F.max("own").alias("high")
    )
    radius = 1 - cut.percent / 100 + 1e-5
    to_ring = F.element_at("distances", F.col("nearest") + 1)
    visits = (
        homes.join(main, "cluster")
        .where("component <> main")
        .select("cluster", "key", "distances", "shingles")
        .join(rings, "cluster")
        .where(to_ring.between(F.col("low") - radius, F.col("high") + radius))
    )
    columns = ("cluster", "nearest", "part", "key", "distances", "shingles")
    crossing = (
        homes.select(*columns, F.lit(False).alias("visitor"))
        .unionByName(visits.select(*columns, F.lit(True).alias("visitor")))
        .groupBy("cluster", "nearest", "part")
        .applyInArrow(_across(cut), "a binary, b binary")
    )
    return edges.unionByName(crossing)


# ------------------------------------------------------------------ the join


def _sets_of(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, blobs in _pieces(batch["text"]):
                hashes, _, sizes = shingle_sets(blobs, n)
                stops = np.cumsum(sizes)
                keys = set_keys(hashes, sizes)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array([k.tobytes() for k in keys], pa.binary()),
                        "wanted": batch["wanted"][start:end],
                        "shingles": pa.array(
                            [hashes[a:b].tobytes() for a, b in zip(stops - sizes, stops, strict=True)],
                            pa.binary(),
                        ),
                    }
                )
        release()

    return run


def _address(text: Column) -> Column:
    """Where to find a document again: its id, or the hash of its text if it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.xxhash64(text)))


def _tie(text: Column) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(text)


def ngram_components(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_key`` of every row of ``docs``.

    ``class_key`` is equal for rows with equal sets (null: no set); ``component_id``
    is the least id that links reach.
    """
    return _linked_rows(docs, settings).select("doc_id", "n_shingles", "component_id", "class_key")


def _linked_rows(docs: DataFrame, settings: Settings | None) -> DataFrame:
    """The columns of ``ngram_components``, with the component's own key and the tie of the text."""
    cut = settings or Settings()
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _address(text).alias("address"),
        _tie(text).alias("tie"),
        text.alias("text"),
    )
    shapes = written(
        source.mapInArrow(
            _shapes(cut.n),
            "doc_id long, address string, tie long, key binary, n long, sketch binary, block int",
        ),
        "shapes",
    )
    levels = _levels(shapes)
    rows = shapes.where("block IS NULL")
    classes = written(
        rows.where("n > 0")
        .groupBy("key", "n", "sketch")
        .agg(F.min("doc_id").alias("low_id"), F.min("address").alias("address")),
        "classes",
    )
    total = rows.agg(F.sum(F.col("n") * (100 - cut.percent) / 100 + 1)).head()[0] or 0
    buckets = max(8, int(total // cut.bucket_entries) + 1)
    kinds = (
        source.select("text")
        .mapInArrow(_entries(cut, levels, buckets), "bucket long, sure boolean, blob binary")
        .groupBy("bucket")
        .applyInArrow(_regions(cut), "p binary, x binary, sure boolean")
    )
    # A class can be in a region by a sure shingle and by a rare one: the latter is compared all the same.
    regions = written(kinds.distinct(), "regions")
    near = (
        regions.where("NOT sure")
        .join(classes.select(F.col("key").alias("x"), "n", "sketch"), "x")
        .groupBy("p")
        .applyInArrow(_survivors(cut.percent), "a binary, b binary")
    )
    sure = regions.where("sure").select(F.col("p").alias("a"), F.col("x").alias("b"))
    clusters = components(near.unionByName(sure)).withColumnsRenamed(
        {"node": "key", "component": "cluster"}
    )
    sized = classes.select("key", "n", "address", "low_id").join(clusters, "key")
    weight = sized.groupBy("cluster").agg(F.sum("n").alias("_size"))
    parts = F.ceil(F.col("_size") / cut.cluster_shingles).alias("parts")
    members = written(
        sized.join(weight.select("cluster", parts), "cluster"), "members"
    )
    wanted = members.select("address", F.col("key").alias("wanted"))
    sets = (
        maybe_in(source.select("address", "text"), wanted, "address")
        .join(wanted, "address")
        .mapInArrow(_sets_of(cut.n), "key binary, wanted binary, shingles binary")
        .where("key = wanted")
        .select("key", "shingles")
        .dropDuplicates(["key"])
    )
    inside = (
        members.where("parts = 1")
        .select("key", "cluster")
        .join(sets, "key")
        .groupBy("cluster")
        .applyInArrow(_exact(cut), "node binary, component binary")
    )
    if not members.where("parts > 1").isEmpty():
        edges = _large(members.where("parts > 1").select("cluster", "key", "parts"), sets, cut)
        inside = inside.unionByName(components(edges))
    joined = classes.select("key", "low_id").join(
        inside.withColumnRenamed("node", "key"), "key", "left"
    ).withColumn("component", F.coalesce("component", "key"))
    joined = written(joined, "joined")
    least = joined.groupBy("component").agg(F.min("low_id").alias("component_id"))
    by_key = joined.join(least, "component").select("key", "component", "component_id")
    linked = rows.where("n > 0").select("doc_id", "tie", "n", "key").join(by_key, "key")
    out = (
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("class_key"), "component", "tie"
    )
    none = F.lit(None).cast("binary")
    alone = rows.where("n = 0").select(
        "doc_id", "tie", "n", F.col("doc_id").alias("component_id"), none.alias("key"), none.alias("component")
    )
    return linked.select(*out).unionByName(alone.select(*out))


def keep_one_of_each(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row of each component, with all its columns: of the least id (null: last), then text hash.

    Rows without words all stay. Rows are told apart by id and text hash; of rows equal
    in both any one stays.
    """
    found = _linked_rows(docs, settings).select("doc_id", "tie", "component")
    best = (
        found.where("component IS NOT NULL")
        .groupBy("component", "doc_id", "tie")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("component")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tie", "copies")).alias("best"))
        .select("best.doc_id", "best.tie", (F.col("best.copies") > 1).alias("several"))
    )
    wordless = found.where("component IS NULL").select("doc_id", "tie", F.lit(False).alias("several")).distinct()
    stay = written(best.unionByName(wordless), "stay")
    free = [name for i in range(len(docs.columns) + 3) if (name := f"_stay{i}") not in docs.columns]
    mark, tie, several = free[:3]
    stay = stay.toDF(mark, tie, several)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(mark)) & (_tie(F.col("text").cast("string")) == F.col(tie))
    kept = docs.join(stay.where(~F.col(several)), same).select(*docs.columns)
    repeated = stay.where(several)
    if not repeated.isEmpty():
        one = docs.join(repeated, same).dropDuplicates([mark, tie])
        kept = kept.unionByName(one.select(*docs.columns))
    return kept
