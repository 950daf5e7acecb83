"""Approximate nearest neighbours by cosine over a hierarchical k-means tree.

The tree is fitted on a bounded sample of unit vectors; every vector is then
placed in the leaf that greedy descent reaches. A query visits leaves best bin
first: a priority queue holds branches by the distance of their centres. How many
leaves are visited is calibrated: for some sampled vectors the exact neighbours
are found among all vectors, and visits are widened until the wanted share of
them lies in visited leaves. Found candidates are ranked by the exact measure.

Equal vectors lie in one leaf, and of a vector's copies only the ``k + 1`` with
the smallest ids can be among the ``k`` nearest of any query; only those are
indexed, chosen within each task before the shuffle. Leaves and their queries are
cut into tiles of bounded size.

Edge cases: vectors that are null, zero, hold null or non-finite components, or
differ in length from most, take no part, nor do null ids. A query's own id is no
candidate; rows that repeat id and vector count once. With fewer than ``k``
candidates a query gets all of them; without vectors the result is empty. Columns
other than id and vector are not read.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.llm.scratch import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Settings:
    k: int = 5
    sample: int = 20_000  # vectors that the tree is fitted on
    branches: int = 12
    leaf_rows: int = 400  # wanted vectors in a leaf
    least_sample: int = 24  # sampled vectors that a split needs
    calibration: int = 200  # sampled vectors whose exact neighbours are found
    recall: float = 0.98
    tile: int = 4096
    seed: int = 11


@dataclass
class Tree:
    """Nodes: child centres and numbers; a node without children is a leaf with a number."""

    centres: list[np.ndarray | None] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector."""
        out = np.full(len(x), -1, np.int64)
        pending = [(0, np.arange(len(x)))]
        while pending:
            node, rows = pending.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            near = np.argmax(x[rows] @ self.centres[node].T, axis=1)
            for i, child in enumerate(self.children[node]):
                part = rows[near == i]
                if len(part):
                    pending.append((child, part))
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            for child, nearness in zip(self.children[node], self.centres[node] @ q, strict=True):
                heapq.heappush(queue, (-float(nearness), child))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres (unit vectors) of at most ``k`` groups of unit vectors."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        fresh = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
        if np.allclose(fresh, centres, atol=1e-7):
            break
        centres = fresh
    return np.unique(centres, axis=0)


def grow_tree(x: np.ndarray, rows: int, cut: Settings) -> Tree:
    """Tree on the sample ``x`` of ``rows`` unit vectors."""
    rng, tree = np.random.default_rng(cut.seed), Tree()

    def node() -> int:
        tree.centres.append(None), tree.children.append([]), tree.leaf.append(-1)
        return len(tree.leaf) - 1

    pending, number = [(node(), x)], 0
    while pending:
        at, part = pending.pop()
        expected = rows * len(part) / max(len(x), 1)
        centres = None
        if expected > cut.leaf_rows and len(part) >= cut.least_sample:
            wanted = min(cut.branches, max(2, int(np.ceil(expected / cut.leaf_rows))))
            centres = k_means(part, wanted, rng)
        if centres is None or len(centres) < 2:
            tree.leaf[at] = number
            number += 1
            continue
        near = np.argmax(part @ centres.T, axis=1)
        tree.centres[at] = centres
        for i in range(len(centres)):
            child = node()
            tree.children[at].append(child)
            pending.append((child, part[near == i]))
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first: the squares of very large or very small components would leave the range.
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of ``q`` with each row, row by row, so equal rows get equal values.

    Both are scaled by powers of two, which changes no digit and keeps squares in range.
    """
    q = np.ldexp(q, -np.frexp(np.abs(q).max())[1])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    dots = (x * q).sum(axis=1)
    return dots / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def best(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Query, positions and cosines of its ``k`` nearest rows, ties to smaller ids."""
    near = _unit(queries) @ _unit(rows).T
    for i, query in enumerate(query_ids):
        open_ = np.flatnonzero(ids != query)
        if len(open_) > k:
            low = -np.partition(-near[i, open_], k - 1)[k - 1]
            open_ = open_[near[i, open_] >= low - 1e-9]
        if not len(open_):
            continue
        exact = cosines(queries[i], rows[open_])
        first = np.lexsort((ids[open_], -exact))[:k]
        yield i, open_[first], exact[first]


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part; ``embedding`` as doubles."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    finite = F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    rows = rows.where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
        & F.exists("embedding", lambda v: v != 0)
    )
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (sizes["n"] if sizes else 0))


def _placed(tree: Tree) -> Callable:
    def run(vectors: pa.Array) -> pa.Array:
        return pa.array(tree.place(_unit(_matrix(vectors))).astype(np.int32))

    return run


def _exact_part(queries: np.ndarray, query_ids: np.ndarray, k: int) -> Callable:
    """The nearest rows of each batch for some queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = _matrix(batch["embedding"]), batch["vec_id"].to_numpy()
            leaf = batch["leaf"].to_numpy()
            for i, at, scores in best(queries, query_ids, rows, ids, k):
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array(np.full(len(at), query_ids[i])),
                        "vec_id": pa.array(ids[at]),
                        "leaf": pa.array(leaf[at]),
                        "score": pa.array(scores),
                    }
                )

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_neighbours(index: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """Brute force over all rows of an index (vec_id, embedding, leaf) for a block of queries."""
    found = index.mapInArrow(
        _exact_part(queries, query_ids, k), "query_id long, vec_id long, leaf int, score double"
    )
    return _top(found, k)


def calibrated_visits(tree: Tree, index: DataFrame, sample: pa.Table, cut: Settings) -> int:
    """Least number of visited leaves that holds the wanted share of exact neighbours."""
    some = sample.slice(0, cut.calibration)
    queries, ids = _matrix(some["embedding"]), some["vec_id"].to_numpy()
    exact = exact_neighbours(index, queries, ids, cut.k).collect()  # calibration x k rows
    if not exact:
        return 1
    order = {int(i): {leaf: n for n, leaf in enumerate(tree.visit(q))} for i, q in zip(ids, _unit(queries), strict=True)}
    needed = np.sort([order[r["query_id"]][r["leaf"]] + 1 for r in exact])
    return int(needed[min(len(needed) - 1, int(np.ceil(cut.recall * len(needed))) - 1)])


def _visits(tree: Tree, visits: int, sizes: np.ndarray, k: int) -> Callable:
    """Leaves that a query visits: the calibrated number, more while they hold too few rows."""

    def run(vectors: pa.Array) -> pa.Array:
        out = []
        for q in _unit(_matrix(vectors)):
            seen, rows = [], 0
            for leaf in tree.visit(q):
                if len(seen) >= visits and rows > k:
                    break
                seen.append(leaf)
                rows += sizes[leaf]
            out.append(seen)
        return pa.array(out, pa.list_(pa.int32()))

    return run


def _tile(k: int) -> Callable:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        ids, query_ids = held["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        rows = _matrix(held["embedding"])
        parts = []
        for start in range(0, len(query_ids), 512):
            some = asked.slice(start, 512)
            few = query_ids[start : start + 512]
            for i, at, scores in best(_matrix(some["embedding"]), few, rows, ids, k):
                parts.append((np.full(len(at), few[i]), ids[at], scores))
        if not parts:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)

    return run


def nearest(vectors: DataFrame, is_query: Column, settings: Settings | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` that ``is_query`` names."""
    cut = settings or Settings()
    rows = valid_vectors(vectors)
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.distinct().withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= cut.k + 1)
    kept = written(kept, "vectors")
    first = kept.where(F.col("_copy") == 1)
    total = first.count()
    sample = (
        first.select("vec_id", "embedding")
        .orderBy(F.xxhash64("vec_id", F.lit(cut.seed)), "vec_id")
        .limit(cut.sample)
        .toArrow()
    )
    tree = grow_tree(_unit(_matrix(sample["embedding"])), total, cut)
    leaf = F.arrow_udf(_placed(tree), "int")("embedding")
    index = written(kept.select("vec_id", "embedding", leaf.alias("leaf")), "index")
    visits = calibrated_visits(tree, index, sample, cut)
    sizes = np.zeros(max(tree.leaves, 1), np.int64)
    for row in index.groupBy("leaf").count().collect():  # a row a leaf, as many as the sample allows
        sizes[row["leaf"]] = row["count"]
    asked = rows.where(is_query).distinct().select(F.col("vec_id").alias("query_id"), "embedding")
    visited = F.explode(F.arrow_udf(_visits(tree, visits, sizes, cut.k), "array<int>")("embedding"))
    asked = written(asked.select("query_id", "embedding", visited.alias("leaf")), "asked")
    # Tiles: parts of a leaf's rows by parts of its queries.
    held = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / cut.tile).cast("int").alias("_rows"))
    wanted = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / cut.tile).cast("int").alias("_queries"))
    tiles = held.join(wanted, "leaf")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def own(name: str, n: str) -> Column:
        return F.pmod(F.xxhash64(name), F.col(n)).cast("int")

    left = asked.join(tiles, "leaf").select(
        "query_id", "embedding", "leaf", own("query_id", "_queries").alias("q"), every("_rows").alias("r")
    )
    right = index.join(tiles, "leaf").select(
        "vec_id", "embedding", "leaf", own("vec_id", "_rows").alias("r"), every("_queries").alias("q")
    )
    found = (
        left.groupBy("leaf", "q", "r")
        .cogroup(right.groupBy("leaf", "q", "r"))
        .applyInArrow(_tile(cut.k), "query_id long, vec_id long, score double")
    )
    return _top(found.distinct(), cut.k).select("query_id", "rank", "vec_id", "score")
