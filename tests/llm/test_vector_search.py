from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from slotledger.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, label int, leaf int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1) for i, v in rows], SCHEMA)


def _brute(rows, k=5):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    out = {}
    for i, q in ok:
        if i % 50 == 0:
            scored = [(-float(q @ v / np.sqrt(v @ v) / np.sqrt(q @ q)), j) for j, v in ok if j != i]
            out[i] = [(j, -s) for s, j in sorted((round(s, 12), j) for s, j in scored)[:k]]
    return out


def _found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def _query(df, **settings):
    return vector_search.nearest(df, F.col("vec_id") % 50 == 0, vector_search.Settings(**settings))


def test_awkward_vectors_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(i, list(rng.normal(size=6).astype(np.float32))) for i in range(120)]
    rows += [(200 + i, rows[50][1]) for i in range(40)]  # copies of a query
    rows += [(300, None), (301, [0] * 6), (302, [1, None, 1, 1, 1, 1]), (303, [float("nan")] + [1] * 5),
             (304, [float("inf")] + [1] * 5), (305, [1, 2]), (None, [1] * 6), (3, rows[3][1])]
    wanted = _brute([r for r in rows if r[0] not in (305,)][:-1])
    found = _found(_query(_frame(spark, rows)))
    assert found.keys() == wanted.keys()
    for query, pairs in wanted.items():
        assert [j for j, _ in found[query]] == [j for j, _ in pairs]
        assert np.allclose([s for _, s in found[query]], [s for _, s in pairs], atol=1e-12)


def test_few_and_no_vectors(spark):
    assert _found(_query(_frame(spark, [(0, [1, 0]), (1, [0, 1])]))) == {0: [(1, 0.0)]}
    assert _query(_frame(spark, [(0, [1, 0])])).count() == 0
    assert _query(_frame(spark, [(0, None)])).count() == 0
    assert _query(_frame(spark, [])).count() == 0


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    wanted = _brute(rows)
    found = _found(_query(df, leaf_rows=30, least_sample=8, tile=16))
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in pairs}) for q, pairs in wanted.items())
    assert found.keys() == wanted.keys() and hits >= 0.9 * sum(map(len, wanted.values()))


def test_leaves_are_visited_from_the_nearest_on():
    rng = np.random.default_rng(1)
    x = vector_search._unit(rng.normal(size=(3000, 8)))
    tree = vector_search.grow_tree(x, len(x), vector_search.Settings(leaf_rows=100))
    assert tree.leaves > 10
    order = list(tree.visit(x[0]))
    assert sorted(order) == list(range(tree.leaves)) and order[0] == tree.place(x[:1])[0]


def test_cosines_of_very_large_and_very_small_vectors():
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=16), rng.normal(size=(50, 16))
    plain = (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
    assert (vector_search.cosines(q, x) == plain).all()
    for a, b in ((1e200, 1e200), (1e-200, 1e-200), (1e300, 1e-300)):
        assert np.allclose(vector_search.cosines(q * a, x * b), plain, rtol=0, atol=1e-12)
