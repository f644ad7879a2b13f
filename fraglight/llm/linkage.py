"""Problem 4: new batches against all history, by incremental record linkage.

Places are blocked by campaign, file and a range of lines; the blocking-key table is kept in a folder (buckets.py), with the
earliest sighting of each line. A batch reads only the buckets of its own blocks and their neighbours, links its lines to
known ones by a weighted sum of how their fields agree, and appends the lines that it changes. The weights are those of a
logistic model, learned anew with each batch from the counts of all agreement patterns of blocked pairs so far, labelled
by the definition of a place; the model alone decides about a pair afterwards. Clusters are a union-find forest: a batch looks up the representatives of the nodes that it
links, joins those, and appends the pointers that change; no other cluster is touched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraglight.llm.buckets import ROWS, Buckets
from fraglight.llm.components import components
from fraglight.sources.tables import discard, staged

NEAR, BLOCK = 3, 8
#: A sighting before all iterations.
BEFORE = -(1 << 62)
_MOMENT = "struct<iter:bigint,pos:bigint>"


def place(location: Column) -> tuple[Column, Column, Column]:
    """File counted from `compiler` or `library` on, line and column of a location, however it is spelled."""
    path = F.regexp_replace(F.regexp_replace(F.lower(location), r"\\", "/"), r"/(\./)*/*(\./)*", "/")
    where = r"(?:^|.*?[^\w-])((?:compiler|library)/[^\s:(),#]*?\.rs)\W*l?(\d+)?(?:\D+(\d+))?"
    part = lambda k: F.nullif(F.regexp_extract(path, where, k), F.lit(""))
    return part(1), part(2).try_cast("bigint"), part(3).try_cast("bigint")


def learned(patterns: list[tuple[int, bool, bool, int]], rounds: int = 200) -> list[float]:
    """(gap of lines, same column, label, pairs) -> weights of a logistic model: bias, each line of gap, same column. Newton steps
    with a ridge that is lowered until no pattern is on the wrong side, or it is spent."""
    x = np.array([(1.0, gap, column) for gap, column, _, _ in patterns] or [(1.0, 0.0, 0.0)])
    y = np.array([label for _, _, label, _ in patterns] or [True], float)
    n = np.array([count for *_, count in patterns] or [1], float)
    w = np.zeros(3)
    for ridge in 10.0 ** -np.arange(1, 12):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            slope = x.T @ (n * (p - y)) + ridge * w
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), slope)
            w = w - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-9:
                break
        if (((x @ w) > 0) == (y > 0)).all():
            break
    return [float(v) for v in w]


def _latest(lines: DataFrame) -> DataFrame:
    """Sightings, links and columns only fall, so the latest version of a line has the least of each."""
    return lines.groupBy("campaign", "file", "line").agg(F.min("first").alias("first"), F.min("col").alias("col"), F.min("reach").alias("reach"))


class Linker:
    """History of the places that campaigns have had. A batch may come late: what it changes is found again in its blocks. A path
    that holds a history opens it, with its weights."""

    def __init__(self, spark: SparkSession, near: int = NEAR, path: str | None = None, clusters: bool = False, rows: int = ROWS):
        tables = {
            "lines": (f"campaign string, file string, line bigint, first {_MOMENT}, col bigint, reach {_MOMENT}, block bigint", ["campaign", "file", "block"]),
            "forest": ("node string, parent string", ["node"]),
        }
        self.kept = Buckets(spark, tables, path, rows)
        self.near, self.path, self.clustered = near, self.kept.path, clusters

    @property
    def weights(self) -> list[float]:
        return self.kept.notes.get("weights", [0.0, 0.0, 0.0])

    def known(self) -> DataFrame:
        """(campaign, file, line, first, col, reach): all lines, valid until the next add()."""
        return _latest(self.kept.read("lines"))

    def _learn(self, pairs: DataFrame) -> None:
        """Counts the agreement patterns of the batch's blocked pairs, adds them to those so far, and fits the model again."""
        seen = {(g, c): n for g, c, n in self.kept.notes.get("patterns", [])}
        for gap, column, n in pairs.groupBy("gap", "same_col").count().collect():  # gaps within two blocks: 32 rows at most
            seen[gap, column] = seen.get((gap, column), 0) + n
        self.kept.notes["patterns"] = [[g, c, n] for (g, c), n in sorted(seen.items())]
        self.kept.notes["weights"] = learned([(g, c, g <= self.near, n) for (g, c), n in sorted(seen.items())])

    def score(self) -> Column:
        bias, gap, column = self.weights
        return F.lit(bias) + F.col("gap") * gap + F.when(F.col("same_col"), column).otherwise(0.0)

    def add(self, batch: DataFrame) -> None:
        """batch (campaign, file, line, col, iter, pos): sightings."""
        kept = self.kept
        block = lambda shift=0: F.floor(F.col("line") / BLOCK) + shift
        around = F.explode(F.array(*(block(k) for k in (-1, 0, 1)))).alias("block")
        sightings = batch.filter("campaign is not null and file is not null and line is not null")
        lines = sightings.groupBy("campaign", "file", "line").agg(F.min(F.struct("iter", "pos")).alias("first"), F.min("col").alias("col"))
        lines = staged(lines, "lines")
        if not (more := lines.count()):
            return
        kept.grow("lines", more, lambda x: _latest(x).withColumn("block", block()))
        near = staged(lines.select("campaign", "file", around).distinct(), "near")
        touched = kept.touched("lines", near)
        old = staged(_latest(kept.read("lines", touched).join(near, ["campaign", "file", "block"], "left_semi")), "old")
        merged = old.unionByName(lines, allowMissingColumns=True)
        merged = staged(_latest(merged).withColumnRenamed("reach", "was"), "merged")
        # candidates: lines of the batch's blocks and their neighbours, each with the lines known near it
        other = merged.select("campaign", "file", around, F.col("line").alias("line2"), F.col("first").alias("first2"), F.col("col").alias("col2"))
        pairs = merged.withColumn("block", block()).join(other, ["campaign", "file", "block"])
        pairs = pairs.withColumns({"gap": F.abs(F.col("line") - F.col("line2")), "same_col": F.col("col").eqNullSafe(F.col("col2"))})
        pairs = staged(pairs.select("campaign", "file", "line", "line2", "first2", "gap", "same_col"), "pairs")
        self._learn(pairs)
        links = pairs.filter(self.score() > 0)
        reach = links.groupBy("campaign", "file", "line").agg(F.min("first2").alias("reach"))
        # a line of a neighbouring block may have its earliest link in a block that isn't read; sightings only get earlier
        new = merged.join(reach, ["campaign", "file", "line"], "left").select("campaign", "file", "line", "first", "col", F.least("reach", "was", "first").alias("reach"), block().alias("block"))
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("campaign", "file", "line", "first", "col", "reach")]
        changed = staged(new.alias("n").join(old.alias("o"), [a for a in same[:3]], "left").filter(~(same[3] & same[4] & same[5]) | F.col("o.line").isNull()).select("n.*"), "changed")
        due = kept.outgrown("lines", {b: n for b, n in changed.groupBy(kept.bucket("lines").alias("b")).count().collect()})
        if due:
            rest = _latest(kept.read("lines", due)).join(changed, ["campaign", "file", "line"], "left_anti").withColumn("block", block())
            kept.write("lines", changed.unionByName(rest), due)
        else:
            kept.write("lines", changed)
        if self.clustered:
            self._unite(links.filter("line < line2"), lines)
        kept.commit()
        for done in (lines, near, old, merged, pairs, changed):
            discard(done)

    def _parents(self, nodes: DataFrame) -> DataFrame:
        """nodes (node) -> (node, parent): pointers of nodes that have one; versions of a pointer only fall."""
        read = self.kept.read("forest", self.kept.touched("forest", nodes)).groupBy("node").agg(F.min("parent").alias("parent"))
        return read.join(nodes.distinct(), "node", "left_semi")

    def _roots(self, nodes: DataFrame) -> DataFrame:
        """nodes (node) -> (node, root): pointers followed to their end, in as many joins as the longest path has steps."""
        now = staged(nodes.distinct().withColumn("root", F.col("node")), "roots")
        while True:
            up = self._parents(now.select(F.col("root").alias("node"))).withColumnRenamed("node", "root")
            up = staged(up.filter("parent <> root"), "up")
            if up.isEmpty():
                discard(up)
                return now
            moved = staged(now.join(up, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
            for done in (now, up):
                discard(done)
            now = moved

    def _unite(self, links: DataFrame, lines: DataFrame) -> None:
        """Joins the representatives of the nodes that the links touch. Written are the pointers of the batch's nodes and of the
        representatives that have a smaller one now."""
        node = lambda line: F.concat_ws(" ", "campaign", "file", F.lpad(F.col(line).cast("string"), 12, "0"))
        edges = staged(links.select(node("line").alias("x"), node("line2").alias("y")).distinct(), "edges")
        nodes = edges.select(F.col("x").alias("node")).union(edges.select("y")).union(lines.select(node("line")))
        self.kept.grow("forest", nodes.count(), lambda forest: forest.groupBy("node").agg(F.min("parent").alias("parent")))
        roots = self._roots(nodes)
        named = edges.join(roots.withColumnRenamed("node", "x").withColumnRenamed("root", "a"), "x").join(roots.withColumnRenamed("node", "y").withColumnRenamed("root", "b"), "y")
        joined = components(named, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("top"))
        of_nodes = roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("parent"))
        changed = staged(of_nodes.union(joined.select("root", "top")).distinct(), "pointers")
        had = self._parents(changed.select("node")).withColumnRenamed("parent", "had")
        self.kept.write("forest", changed.join(had, "node", "left").filter("had is null or had <> parent").select("node", "parent"))
        for done in (edges, roots, changed):
            discard(done)

    def clusters(self) -> DataFrame:
        """(node, root): every line, as campaign, file and line, with the representative of its cluster."""
        return self._roots(self.kept.read("forest").select("node"))

    def repeated(self, sightings: DataFrame) -> DataFrame:
        """The sightings at a place that the campaign had before."""
        joined = sightings.join(self.known().select("campaign", "file", "line", "reach"), ["campaign", "file", "line"])
        return joined.filter(F.col("reach") < F.struct("iter", "pos"))


def sightings(batches: DataFrame) -> DataFrame:
    """(campaign_id, iter, new_locations) -> (campaign, file, line, col, iter, pos), one row for each entry; repeated rows
    count once. Null campaigns, iterations and lists, null entries, and those that name no source file with a line give
    none."""
    each = batches.filter("campaign_id is not null and iter is not null").select(F.col("campaign_id").alias("campaign"), "iter", F.posexplode("new_locations").alias("pos", "location"))
    file, line, col = place(F.col("location"))
    each = each.select("campaign", file.alias("file"), line.alias("line"), col.alias("col"), "iter", F.col("pos").cast("bigint").alias("pos"))
    return each.filter("file is not null and line is not null").dropDuplicates(["campaign", "iter", "pos"])


def link_history(seen: DataFrame, iterations: DataFrame, order: str = "logged_at", batches: int = 2, clusters: bool = False, path: str | None = None) -> tuple[Linker, DataFrame]:
    """The history of all campaigns: `seen` first, then `iterations` in batches as they were logged, late ones late. Gives
    the linker and all sightings. Repeated rows count once, null entries not at all; empty tables give empty results."""
    from fraglight.llm.ledger import in_batches

    linker = Linker(iterations.sparkSession, path=path, clusters=clusters)
    file, line, col = place(F.col("location"))
    before = F.lit(BEFORE).cast("bigint")
    linker.add(seen.select(F.col("campaign_id").alias("campaign"), file.alias("file"), line.alias("line"), col.alias("col"), before.alias("iter"), before.alias("pos")))
    for batch in in_batches(iterations, order, batches):
        linker.add(sightings(batch))
    return linker, sightings(iterations)
