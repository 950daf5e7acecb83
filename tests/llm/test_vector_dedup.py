from __future__ import annotations

import numpy as np
import pytest

from slotledger.llm import vector_dedup
from slotledger.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, label int, cls int, n int, code int, codes int, links int"


def _frame(spark, rows):
    plain = [(i, None if v is None else [None if x is None else float(x) for x in v], *[7] * 6) for i, v in rows]
    return spark.createDataFrame(plain, SCHEMA)


def _brute(rows):
    """Sorted (vec_id, n_links, component_id, kept); rows of another length than the first do not link."""
    ok = []
    for k, (i, v) in enumerate(rows):
        if i is not None and v is not None and None not in v and len(v) == len(rows[0][1]):
            x = np.array(v, np.float32).astype(float)
            if np.isfinite(x).all() and x.any():
                ok.append((k, x))
    at = [k for k, _ in ok]
    z = np.array([x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max() for _, x in ok])
    links, root = np.zeros(len(rows), int), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(z @ z.T >= 0.95), strict=True):
        if a != b:
            links[at[a]] += 1
            root[find(at[a])] = find(at[b])
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    found = [(i, int(links[k]), low.get(find(k)), i == low.get(find(k))) for k, (i, _) in enumerate(rows)]
    return sorted(found, key=repr)


def _found(df, **settings):
    out = vector_dedup.near_groups(df, vector_dedup.Settings(**settings))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def _vectors(seed=0, n=300, size=8):
    rng = np.random.default_rng(seed)
    rows = [(i, list(rng.normal(size=size).astype(np.float32))) for i in range(n)]
    base = rng.normal(size=size)
    rows += [(1000 + i, list((base + rng.normal(size=size) * 0.1).astype(np.float32))) for i in range(90)]
    return rows


def test_awkward_vectors(spark):
    rows = _vectors()
    rows += [(2000 + i, rows[5][1]) for i in range(40)]  # copies
    rows += [(2100, [2 * x for x in rows[5][1]]), (2101, [-x for x in rows[5][1]])]
    rows += [(3000, None), (3001, [0] * 8), (3002, [1, None, *[1] * 6]), (3003, [float("nan")] + [1] * 7),
             (3004, [float("inf")] + [1] * 7), (3005, [1, 2]), (3006, []), (None, rows[5][1]), (5, rows[5][1]),
             (6, rows[7][1]), (3007, [1e38] * 8), (3008, [1e-38] * 8)]
    assert _found(_frame(spark, rows).repartition(3)) == _brute(rows)


@pytest.mark.parametrize("settings", [
    {"leaf_rows": 40, "sample": 4000, "trees": 12}, {"leaf_rows": 40, "sample": 64, "node_sample": 100, "trees": 12},
    {"tile": 30}])
def test_small_leaves_rounds_and_tiles_find_all_links(spark, settings):
    """Leaves split by the first sample, by samples of their own, and crowds compared in tiles."""
    rows = _vectors(seed=1, n=700)
    assert _found(_frame(spark, rows), **settings) == _brute(rows)


def test_a_crowd_stays_one_leaf():
    rng = np.random.default_rng(2)
    x = vector_dedup.unit(np.vstack([rng.normal(size=(300, 16)), np.ones(16) + rng.normal(size=(200, 16)) * 0.05]))
    tree = vector_dedup.grow(x, 5000, vector_dedup.Settings(leaf_rows=50), 3)
    rows, leaves = tree.place(x)
    crowded = [leaf for leaf, c in enumerate(tree.crowded) if c]
    assert crowded and set(range(300, 500)) <= set(rows[np.isin(leaves, crowded)])


def test_no_vectors(spark):
    assert _found(_frame(spark, [])) == []
    assert _found(_frame(spark, [(4, None)])) == [(4, 0, 4, True)]
    assert _found(_frame(spark, [(0, [1, 0])])) == [(0, 0, 0, True)]


def test_recall_of_the_registered_query(spark):
    """Copies with noise are planted among the given vectors; nine of ten links must be found."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    given = [(r["vec_id"], np.array(r["embedding"])) for r in df.collect()]
    rng = np.random.default_rng(3)
    rows = [(i, list(v)) for i, v in given]
    for i, v in given[:60]:
        for j in range(i % 7):
            noise = rng.normal(size=len(v)) * np.linalg.norm(v) / np.sqrt(len(v))
            rows.append((10_000 + 10 * i + j, list((v + 0.18 * noise).astype(np.float32))))
    found, wanted = _found(_frame(spark, rows)), _brute(rows)
    assert sum(r[1] for r in wanted) > 300
    assert all(a[1] <= b[1] for a, b in zip(found, wanted, strict=True))
    assert sum(r[1] for r in found) >= 0.9 * sum(r[1] for r in wanted)
    assert "op11_vector_dedup" in queries()
