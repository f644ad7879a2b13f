"""Tables in buckets, kept in a folder from batch to batch and from session to session.

A batch appends the rows that it changes as a new version of the buckets that it touches; what it writes grows with the
batch, not with the history. A bucket whose appended rows outgrow the others is written whole again, and all are dealt
anew, to twice as many, when the table outgrows them. A manifest names the versions that count; it is written last, so a
batch that fails leaves the tables as they were.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraglight.sources.tables import drop_path, new_path, path_names

#: Rows of a bucket beyond which the table gets more buckets, and the most buckets (beyond, buckets grow).
ROWS, MOST = 1 << 14, 1 << 16


class Buckets:
    """tables: the schema of each, and the columns by which its rows are dealt to buckets."""

    def __init__(self, spark: SparkSession, tables: dict[str, tuple[str, list[str]]], path: str | None = None, rows: int = ROWS):
        self.spark, self.tables, self.rows = spark, tables, rows
        self.path = path or new_path(spark, "buckets")
        self.serial = 0
        self.size = dict.fromkeys(tables, 1)
        #: For each table and bucket its versions, as [serial, rows].
        self.versions: dict[str, dict[int, list[list[int]]]] = {name: {} for name in tables}
        self.notes: dict = {}
        self._old: list[str] = []
        done = sorted(int(n) for n in path_names(spark, f"{self.path}/manifest") if n.isdigit() and path_names(spark, f"{self.path}/manifest/{n}", "_SUCCESS"))
        if done:
            kept = json.loads(spark.read.text(f"{self.path}/manifest/{done[-1]}", wholetext=True).first()[0])
            self.serial, self.size, self.notes = kept["serial"], kept["size"], kept["notes"]
            self.versions = {name: {int(b): v for b, v in of.items()} for name, of in kept["versions"].items()}

    def commit(self) -> None:
        """Makes the written versions count, and deletes those that don't any more."""
        self.serial += 1
        kept = json.dumps({"serial": self.serial, "size": self.size, "notes": self.notes, "versions": self.versions})
        self.spark.createDataFrame([(kept,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{self.serial}")
        for path in self._old:
            drop_path(self.spark, path)
        for n in path_names(self.spark, f"{self.path}/manifest"):
            if n.isdigit() and int(n) < self.serial:
                drop_path(self.spark, f"{self.path}/manifest/{n}")
        self._old = []

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[name][1]), F.lit(self.size[name])).cast("int")

    def count(self, name: str) -> int:
        """Rows written, those that later versions replace included."""
        return sum(n for of in self.versions[name].values() for _, n in of)

    def touched(self, name: str, df: DataFrame) -> list[int]:
        """The buckets of the rows of df."""
        return sorted(r[0] for r in df.select(self.bucket(name).alias("b")).distinct().collect())  # at most one for each bucket

    def read(self, name: str, touched: list[int] | None = None) -> DataFrame:
        """All versions of the table's rows, or of those in the touched buckets, with their bucket."""
        schema = f"{self.tables[name][0]}, version int, bucket int"
        of = self.versions[name]
        paths = [self._at(name, v, b) for b in (of if touched is None else touched) for v, _ in of.get(b, [])]
        if not paths:
            return self.spark.createDataFrame([], schema).drop("version")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths).drop("version")

    def _at(self, name: str, version: int, bucket: int) -> str:
        return f"{self.path}/{name}/version={version}/bucket={bucket}"

    def outgrown(self, name: str, fresh: dict[int, int]) -> list[int]:
        """Those of the buckets, with the number of rows that come to each, that are due to be written whole."""
        return [b for b, n in fresh.items() if (v := self.versions[name].get(b)) and (sum(k for _, k in v[1:]) + n > v[0][1] or len(v) > 15)]

    def write(self, name: str, df: DataFrame, whole: list[int] = ()) -> None:
        """Appends the rows of df to their buckets; those of `whole` have no other rows from then on."""
        self.serial += 1
        at = f"{self.path}/{name}/version={self.serial}"
        columns = self.spark.createDataFrame([], self.tables[name][0]).columns
        df.select(*columns, self.bucket(name).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        of = self.versions[name]
        for b in whole:
            self._old += [self._at(name, v, b) for v, _ in of.pop(b, [])]
        if path_names(self.spark, at, "bucket="):
            for b, n in self.spark.read.parquet(at).groupBy("bucket").count().collect():
                of.setdefault(b, []).append([self.serial, n])

    def grow(self, name: str, more: int, latest) -> None:
        """Deals the table to more buckets if it outgrows them by `more` rows; latest makes one of all versions of a row."""
        rows, size = self.count(name) + more, self.size[name]
        while size < MOST and rows > size * self.rows:
            size *= 2
        if size == self.size[name]:
            return
        old, every = latest(self.read(name)), list(self.versions[name])
        self.size[name] = size
        if every:
            gone = [self._at(name, v, b) for b in every for v, _ in self.versions[name][b]]
            self.versions[name] = {}
            self.write(name, old)
            self._old += gone
