"""Connected components by alternating large-star and small-star steps, all on Spark.

Each step links nodes to the least neighbour they know. No adjacency list is gathered: the least neighbour is an
aggregate, joined back to the edges. Steps are written to the shared folder, which cuts the lineage and survives the
loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraglight.sources.tables import discard, staged

#: Rounds after which the job gives up with an error; alternating steps need about the logarithm of the longest path.
MOST_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour, or to the node itself."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge, with the least node of its component.

    Rows with a null end and loops link nothing and are left out; repeated edges count once; no edges give no rows. Other
    columns are ignored. Nodes may be of any type that Spark can order."""
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    now, before = staged(now, "edges"), None
    for _ in range(MOST_ROUNDS):
        last, now = now, staged(_small_star(_large_star(now).filter("a <> b").distinct()).filter("a <> b").distinct(), "edges")
        discard(last)
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
