"""Groups of vectors that lie close together, by a forest of random-projection trees.

Each tree splits vectors at the median of their projection on a random direction;
those near the median go to both sides (``spill``). Trees are grown on a bounded
sample, then every vector is placed in all trees. Leaves that hold more than
``leaf_rows`` are split further, each by a sample of its own rows, round after round,
so leaves do not grow with the table. A node whose sampled rows link with each other in
good part is a crowd: splitting it would lose links, so it stays a leaf, and its rows
are compared in tiles.

Rows in one leaf are compared exactly (cosine in double precision). A pair that meets
in several leaves counts in the first leaf both share, which each vector's list of
leaves tells, so no pair is ever written out: a leaf gives each row the number
of its links and the least row it hangs together with. Components follow from those.

Equal vectors are one vector with a count throughout, so masses of copies cost
nothing. Rows with other vectors are searched approximately: recall is measured in
``tests/llm/test_vector_dedup.py`` and in the README.

Edge cases: a vector that is null, zero, holds a null or non-finite component, or has not
the usual length links with nothing and is its own component. So does a row without id;
it has no component and is kept. Rows that repeat an id are rows like any others: equal
vectors link, and the rows of the least id are all kept. No rows give no rows.
Columns other than id and vector are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotledger.llm.graph import components
from slotledger.llm.scratch import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.95
    trees: int = 8
    leaf_rows: int = 1024  # most rows of a leaf, but for crowds
    sample: int = 16_384  # rows that the upper part of a tree is grown on
    node_sample: int = 2048  # rows that a later split is grown on
    least_sample: int = 32  # sampled rows that a split needs
    spill: float = 0.06  # share of the rows on each side of the median that goes to both sides
    crowd: float = 0.05  # share of linked pairs that makes a crowd
    tile: int = 2048  # rows compared at once
    seed: int = 5


LEAF_BITS = 40  # of a leaf's code; the tree is above
ROUND_BITS = 10  # leaves that one later split of a node can give


@dataclass
class Tree:
    """Splits; a node is a number, leaves are numbered from 0 on."""

    directions: list[np.ndarray | None] = field(default_factory=list)
    bounds: list[tuple[float, float]] = field(default_factory=list)
    sides: list[tuple[int, int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    crowded: list[bool] = field(default_factory=list)  # by leaf

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf of every place that the unit vectors ``x`` have."""
        rows, leaves = [], []
        pending = [(0, np.arange(len(x)))]
        while pending:
            node, mine = pending.pop()
            if self.leaf[node] >= 0:
                rows.append(mine)
                leaves.append(np.full(len(mine), self.leaf[node], np.int64))
                continue
            along = x[mine] @ self.directions[node]
            low, high = self.bounds[node]
            left, right = self.sides[node]
            # Both ends are closed, so no row is lost between them.
            pending += [(left, mine[along <= high]), (right, mine[along >= low])]
        return np.concatenate(rows), np.concatenate(leaves)


def _is_crowd(x: np.ndarray, cut: Settings, rng: np.random.Generator) -> bool:
    some = x if len(x) <= 256 else x[rng.choice(len(x), 256, replace=False)]
    near = some @ some.T >= cut.cosine
    n = len(some)
    return n > 1 and (near.sum() - n) >= cut.crowd * n * (n - 1)


def grow(x: np.ndarray, rows: float, cut: Settings, seed: int, most: int | None = None) -> Tree:
    """A tree on the sample ``x`` of ``rows`` unit vectors, with ``most`` leaves at most."""
    rng, tree = np.random.default_rng(seed), Tree()

    def node() -> int:
        for part, value in ((tree.directions, None), (tree.bounds, (0.0, 0.0)), (tree.sides, (0, 0)), (tree.leaf, -1)):
            part.append(value)
        return len(tree.leaf) - 1

    pending, leaves = [(node(), x)], 0
    while pending:
        at, part = pending.pop(0)
        expected = rows * len(part) / max(len(x), 1)
        crowded = len(part) > 1 and _is_crowd(part, cut, rng)
        full = most is not None and leaves + len(pending) + 2 > most
        if expected > cut.leaf_rows and len(part) >= cut.least_sample and not crowded and not full:
            direction = rng.normal(size=x.shape[1])
            direction /= np.linalg.norm(direction)
            along = part @ direction
            low, high = np.quantile(along, [0.5 - cut.spill, 0.5 + cut.spill])
            left, right = part[along <= high], part[along >= low]
            if max(len(left), len(right)) < len(part):
                sides = (node(), node())
                tree.directions[at], tree.bounds[at], tree.sides[at] = direction, (low, high), sides
                pending += [(sides[0], left), (sides[1], right)]
                continue
        tree.leaf[at] = leaves
        tree.crowded.append(bool(crowded))
        leaves += 1
    return tree


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by powers of two first, which is exact."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that can link."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(
        F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda v: v != 0)
    )
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (sizes["n"] if sizes else 0))


def _places(trees: list[Tree]) -> Callable:
    """Codes of all leaves of each vector, in order."""

    def run(vectors: pa.Array) -> pa.Array:
        x = unit(_matrix(vectors))
        rows, codes = [], []
        for number, tree in enumerate(trees):
            mine, leaves = tree.place(x)
            rows.append(mine)
            codes.append(leaves | number << LEAF_BITS)
        rows, codes = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((codes, rows))
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(x)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes[order]))

    return run


def _regrown(cut: Settings, round_no: int) -> Callable:
    """A later split of one leaf, as bytes, from its sampled rows."""

    def run(group: pa.Table) -> pa.Table:
        code, rows = group["code"][0].as_py(), group["rows"][0].as_py()
        tree = grow(
            unit(_matrix(group["embedding"])), rows, cut, cut.seed + hash((code, round_no)) % (1 << 32), 1 << ROUND_BITS - 1
        )
        return pa.table({"code": [code], "split": pa.array([cloudpickle.dumps(tree)], pa.binary())})

    return run


def _split_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """New codes of rows whose leaf was split further; other codes stay."""
    trees: dict[bytes, Tree] = {}
    for batch in batches:
        x, splits = unit(_matrix(batch["embedding"])), batch["split"].to_pylist()
        code, ids = batch["code"].to_numpy(), batch["cls"].to_numpy()
        rows, codes, crowded = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
        for split in set(splits):
            if split not in trees:
                if len(trees) > 64:
                    trees.clear()
                trees[split] = cloudpickle.loads(split)
            mine = np.array([i for i, s in enumerate(splits) if s == split])
            at, leaves = trees[split].place(x[mine])
            rows.append(mine[at])
            codes.append(leaves)
            crowded.append(np.array(trees[split].crowded)[leaves])
        rows = np.concatenate(rows)
        yield pa.RecordBatch.from_pydict(
            {"cls": ids[rows], "code": code[rows], "leaf": np.concatenate(codes), "crowded": np.concatenate(crowded)}
        )


def _refined(placed: DataFrame, crowds: set[int], cut: Settings) -> tuple[DataFrame, DataFrame]:
    """``placed`` with all large leaves split, and the number of rows of each leaf.

    Codes of later leaves come from ``(old code, leaf)`` pairs, numbered anew each round.
    """
    dealt = placed.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("rows"))
    sizes = written(dealt.withColumn("crowded", F.col("code").isin(*crowds) if crowds else F.lit(False)), "leaves")
    round_no = 0
    while True:
        large = sizes.where((F.col("rows") > cut.leaf_rows * 2) & ~F.col("crowded"))
        if large.isEmpty():
            return placed, sizes
        round_no += 1
        large = written(large.select("code", "rows"), "large")
        exploded = placed.select("cls", "embedding", F.explode("codes").alias("code")).join(large, "code")
        nth = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("cls", F.lit(round_no)), "cls"))
        sample = exploded.withColumn("_nth", nth).where(F.col("_nth") <= cut.node_sample).drop("_nth")
        grown = sample.groupBy("code").applyInArrow(_regrown(cut, round_no), "code long, split binary")
        splits = written(grown, "splits")
        moved = written(
            exploded.select("cls", "embedding", "code").join(splits, "code").mapInArrow(
                _split_places, "cls long, code long, leaf long, crowded boolean"
            ),
            "moved",
        )
        # A new leaf of the largest codes so far: old codes that stay come first in every list.
        fresh = moved.groupBy("code", "leaf").agg(F.count(F.lit(1)).alias("rows"), F.max("crowded").alias("crowded"))
        bucket = F.pmod(F.xxhash64("code", "leaf"), F.lit(256))
        place = F.row_number().over(Window.partitionBy("_b").orderBy("code", "leaf"))
        fresh = fresh.withColumn("_b", bucket).withColumn("_at", place)
        number = (F.col("_at").cast("long") * 256 + F.col("_b")) + (F.lit(round_no + 64).cast("long") * (1 << LEAF_BITS))
        # Leaves that cannot be split (too few sampled rows apart) are taken as crowds.
        whole = Window.partitionBy("code")
        fresh = written(
            fresh.select(
                "code", "leaf", "rows", number.alias("fresh"),
                (F.col("crowded") | (F.count(F.lit(1)).over(whole) == 1)).alias("crowded"),
            ),
            "fresh",
        )
        new = (
            moved.join(fresh.select("code", "leaf", "fresh"), ["code", "leaf"])
            .groupBy("cls")
            .agg(F.collect_list("fresh").alias("new"), F.collect_set("code").alias("old"))
        )
        none = F.array().cast("array<long>")
        kept_codes = F.array_except("codes", F.coalesce("old", none))
        placed = written(
            placed.join(new, "cls", "left").select(
                "cls", "n", "embedding", F.sort_array(F.concat(kept_codes, F.coalesce("new", none))).alias("codes")
            ),
            "placed",
        )
        stay = sizes.join(large.select("code"), "code", "left_anti")
        sizes = written(stay.unionByName(fresh.select(F.col("fresh").alias("code"), "rows", "crowded")), "leaves")


def _compared(cut: Settings) -> Callable:
    """Links and least connected row of each row of one tile pair of one leaf."""

    def run(group: pa.Table) -> pa.Table:
        code, i, j = (group[name][0].as_py() for name in ("code", "i", "j"))
        ids, n = group["cls"].to_numpy(), group["n"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, n = ids[order], n[order]
        x = unit(_matrix(group["embedding"]))[order]
        block = group["block"].to_numpy()[order]
        lists = [codes for codes in np.array(group["codes"].to_pylist(), dtype=object)[order]]
        # Leaves before this one: what two rows share there has been counted there.
        earlier = [[c for c in codes if c < code] for codes in lists]
        width = max(map(len, earlier))
        seen = np.full((len(ids), width), -1, np.int64)
        for row, codes in enumerate(earlier):
            seen[row, : len(codes)] = codes
        links, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(ids), 256):
            near = x[start : start + 256] @ x.T
            a, b = np.nonzero(near >= cut.cosine - 1e-9)
            a += start
            use = a < b if i == j else (block[a] == i) & (block[b] == j)
            a, b = a[use], b[use]
            exact = near[a - start, b]
            edge = np.abs(exact - cut.cosine) < 1e-9
            exact[edge] = (x[a[edge]] * x[b[edge]]).sum(axis=1)
            a, b = a[exact >= cut.cosine], b[exact >= cut.cosine]
            first = np.ones(len(a), bool)
            for column in range(width):  # a column of a's leaves against all of b's
                mine = seen[a, column]
                first &= ~((seen[b] == mine[:, None]) & (mine[:, None] >= 0)).any(axis=1)
            np.add.at(links, a[first], n[b[first]])
            np.add.at(links, b[first], n[a[first]])
            pairs.append((a, b))
        a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
        while True:  # least row of each local component
            step = low.copy()
            np.minimum.at(step, a, low[b])
            np.minimum.at(step, b, low[a])
            step = step[step]
            if (step == low).all():
                break
            low = step
        linked = np.zeros(len(ids), bool)
        linked[a] = linked[b] = True
        return pa.table({"cls": ids[linked], "links": links[linked], "low": ids[low[linked]]})

    return run


def near_groups(vectors: DataFrame, cut: Settings | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    cut = cut or Settings()
    valid = valid_rows(vectors)
    classes = written(
        valid.groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("n")), "classes"
    )
    # Two vectors can share a least id where rows repeat one: a class is known by a number.
    classes = written(classes.select("cls", "n", "embedding").withColumn("least", F.col("cls"))
                      .withColumn("cls", F.monotonically_increasing_id()), "numbered")
    rows = classes.count()
    picked = classes.orderBy(F.xxhash64("cls", F.lit(cut.seed))).limit(cut.sample)
    found = picked.select("embedding").toPandas()["embedding"]  # cut.sample rows at most
    x = unit(np.stack(found.to_numpy())) if len(found) else np.zeros((0, 1))
    trees = [grow(x, rows, cut, cut.seed + number) for number in range(cut.trees)]
    crowds = {leaf | number << LEAF_BITS for number, t in enumerate(trees) for leaf, c in enumerate(t.crowded) if c}
    codes = F.arrow_udf(_places(trees), "array<long>")(F.col("embedding"))
    placed = written(classes.select("cls", "n", "embedding", codes.alias("codes")), "placed")
    placed, sizes = _refined(placed, crowds, cut)
    tiles = F.ceil(F.col("rows") / cut.tile).cast("int")
    rows_of = placed.select("*", F.explode("codes").alias("code")).join(
        sizes.where("rows > 1").select("code", tiles.alias("tiles")), "code"
    )
    block = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = rows_of.withColumn("block", block).select("*", other.alias("_other")).select(
        "code", "cls", "n", "embedding", "codes", "block",
        F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"),
    )
    found = written(
        tiled.groupBy("code", "i", "j").applyInArrow(_compared(cut), "cls long, links long, low long"), "links"
    )
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("low").alias("b")))
    joined = (
        classes.drop("embedding")
        .join(links, "cls", "left")
        .join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        .select("cls", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "cls").alias("component"))
    )
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = joined.join(least, "component").select("cls", "n_links", "component_id")
    keyed = classes.join(facts, "cls").select("embedding", "n_links", "component_id")
    every = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    key = F.when(F.col("vec_id").isNotNull(), F.col("embedding"))
    return (
        every.select("vec_id", key.alias("embedding"))
        .join(keyed, "embedding", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def near_groups_sql(cosine: float = 0.95) -> str:
    """The same groups in SQL (DuckDB), all pairs compared."""
    return f"""
    WITH RECURSIVE unusual AS (SELECT len(embedding) AS size FROM embeddings WHERE embedding IS NOT NULL
                               GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    valid AS (
      SELECT vec_id, embedding::DOUBLE[] AS e,
             sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))) AS length
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = (SELECT size FROM unusual)
        AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
        AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / a.length / b.length >= {cosine}),
    reached AS (
      SELECT vec_id, vec_id AS other FROM embeddings
      UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
    counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
    FROM reached LEFT JOIN counted USING (vec_id) GROUP BY vec_id, n
"""
