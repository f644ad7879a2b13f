"""Half-open spans: intersection, overlap join, deepest cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersection(a_s: Column, a_e: Column, b_s: Column, b_e: Column) -> Column:
    """struct<s,e> of what two spans share, null if nothing."""
    s, e = F.greatest(a_s, b_s), F.least(a_e, b_e)
    return F.when(s < e, F.struct(s.alias("s"), e.alias("e")))


def overlaps(a_s: Column, a_e: Column, b_s: Column, b_e: Column) -> Column:
    return F.greatest(a_s, b_s) < F.least(a_e, b_e)


def contains(outer_s: Column, outer_e: Column, inner_s: Column, inner_e: Column) -> Column:
    return (inner_s >= outer_s) & (inner_e <= outer_e)


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], width: int = 4096) -> DataFrame:
    """Pairs of spans of the same key that overlap; a has s, e and b has s2, e2. Spans are dealt to bins of `width`, so that
    a key with very many spans is split among tasks; a pair counts in the bin of its later start only."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    left = a.filter("s < e").withColumn("bin", bins("s", "e"))
    right = b.filter("s2 < e2").withColumn("bin", bins("s2", "e2"))
    joined = left.join(right, [*on, "bin"]).filter("s < e2 and s2 < e")
    return joined.filter(F.floor(F.greatest("s", "s2") / width) == F.col("bin")).drop("bin")


def covering(nodes: DataFrame, spans: DataFrame, on: list[str], width: int = 256) -> DataFrame:
    """Pairs of a node (s, e) and a span (s2, e2) of the same key that it covers. A node is dealt to the bins that it reaches into,
    a span to that of its start, so a span meets the nodes about it, not all of its text."""
    left = nodes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    right = spans.withColumn("bin", F.floor(F.col("s2") / width))
    return left.join(right, [*on, "bin"]).filter("s <= s2 and e2 <= e").drop("bin")


def beginning_inside(nodes: DataFrame, spans: DataFrame, on: list[str], width: int = 256) -> DataFrame:
    """Pairs of a node and a span of the same key inside which it begins; in bins likewise."""
    left = nodes.withColumn("bin", F.floor(F.col("s") / width))
    right = spans.filter("s2 < e2").withColumn("bin", F.explode(F.sequence(F.floor(F.col("s2") / width), F.floor((F.col("e2") - 1) / width))))
    return left.join(right, [*on, "bin"]).filter("s2 <= s and s < e2").drop("bin")


def deepest_cover(nodes: DataFrame, spans: DataFrame, on: list[str], key: list[str]) -> DataFrame:
    """For each span (s2, e2) the deepest node (depth, s, e, kind) of its text that covers it; the first of equals."""
    pairs = covering(nodes, spans, on)
    best = F.max_by(F.struct("s", "e", "kind", "depth"), F.struct("depth", (-F.col("s")).alias("x"), (F.col("s") - F.col("e")).alias("y"))).alias("node")
    return pairs.groupBy(*key).agg(best).select(*key, "node.*")
