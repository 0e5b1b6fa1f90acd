"""Connected components by alternating stars; the edges stay in Spark throughout.

Each round points all larger neighbours of a node at the least node it knows, then all
smaller ones. Rounds are about logarithmic in the longest path. A round writes its edges
to the shared folder, so the lineage stays short and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from viewloom.operators.skew import lookup
from viewloom.operators.staging import stored


def _least(edges: DataFrame) -> DataFrame:
    """Per node: the least of its neighbours, and its number of edges."""
    return stored(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count("*").alias("n_rows")))


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges with the least neighbour of `u`; nodes of many edges are dealt over tasks."""
    least = _least(edges)
    counts = least.select(F.col("node").alias("u"), "n_rows")
    return lookup(edges, least.select("node", "m"), {"u": "node"}, "inner", spread=["v"], counts=counts)


def _signature(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    a, b = F.xxhash64("u", "v"), F.xxhash64("v", "u", F.lit(1))
    return tuple(edges.agg(F.count("*"), F.sum(a.cast("decimal(20,0)")), F.sum(b.cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node of an edge to another node: `node` and `root`, the least node it is connected with.

    Edges have no direction; repeated edges, loops and edges with a null end change nothing.
    No edges give an empty table.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    pairs = stored(pairs.distinct())
    before, now = None, _signature(pairs)
    while now != before:  # unchanged edges point every node straight at its root
        if now[0] == 0:
            break
        both = pairs.union(pairs.select("v", "u"))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = stored(large.distinct())
        small = _with_least(large)
        pointed = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(pointed.union(small.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, _signature(pairs)
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = pairs.groupBy("v").agg(F.min("v").alias("root")).select(F.col("v").alias("node"), "root")
    return leaves.union(roots)
