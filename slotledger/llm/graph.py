"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (a, b): the least node it can reach.

    Each round maps a node to the least of itself and its neighbours and rewrites
    the edges; an edge (v, m(v)) becomes (m(v), m(m(v))), so nothing falls apart.
    Edges within one node drop out, and the rounds end when none is left. Nodes
    and edges stay in tables; a node with very many edges is reduced on the map
    side, and joins on it are skew joins that AQE splits. Null nodes and loops
    are left out, repeated edges do not matter; no edges give an empty table.
    """
    left = written(edges.select("a", "b").where("a <> b"), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("b"))
        least = written(low.select(F.col("a").alias("node"), F.least("a", "b").alias("low")), "least")
        maps.append(least)
        ends = (
            left.join(least.withColumnsRenamed({"node": "a", "low": "x"}), "a")
            .join(least.withColumnsRenamed({"node": "b", "low": "y"}), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        left = written(ends, "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0].withColumnRenamed("low", "component")
    for later in maps[1:]:
        step = later.withColumnsRenamed({"node": "component", "low": "next"})
        found = found.join(step, "component", "left").select(
            "node", F.coalesce("next", "component").alias("component")
        )
    return found
