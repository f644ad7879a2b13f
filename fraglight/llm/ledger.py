"""Problem 2: copies of records that formatting hides, kept in an incremental ledger.

The ledger is two bucketed tables in a folder: for each canonical key the number of copies and the earliest
representative, and for each id its key. A batch is aggregated first, then joined in full to the buckets that it touches;
the keys that it changes are appended to them (see buckets.py). The folder can be opened again in another session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraglight.llm.buckets import ROWS, Buckets
from fraglight.sources.tables import discard, staged


def plain(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def canonical_key(text: Column, entries: Column) -> Column:
    """The same for records that differ in formatting or in the order of entries; null for texts without a letter or digit.
    Null, empty and letterless entries count as none, a null list as empty."""
    kept = F.filter(F.transform(F.coalesce(entries, F.array().cast("array<string>")), plain), lambda x: x != "")
    listed = F.array_join(F.array_sort(F.array_distinct(kept)), "\u0001")
    return F.when(plain(text) != "", F.unhex(F.md5(F.concat(plain(text), F.lit("\u0002"), listed))))


def _latest(counts: DataFrame) -> DataFrame:
    """Copies only grow and first ids only fall, so the latest version of a key has the most and the least."""
    return counts.groupBy("key").agg(F.max("copies").alias("copies"), F.min("first_id").alias("first_id"))


class Ledger:
    """Canonical keys with their copies. add() takes batches in any order; a record delivered again counts once. A path that holds
    a ledger opens it."""

    def __init__(self, spark: SparkSession, path: str | None = None, rows: int = ROWS):
        tables = {"counts": ("key binary, copies bigint, first_id bigint", ["key"]), "ids": ("id bigint, key binary", ["id"])}
        self.kept = Buckets(spark, tables, path, rows)
        self.path = self.kept.path

    def add(self, batch: DataFrame) -> None:
        """batch (id bigint, key binary); rows with a null id or key are left out."""
        kept = self.kept
        batch = batch.filter("id is not null and key is not null").groupBy("id").agg(F.min("key").alias("key"))
        batch = staged(batch, "batch")
        if not (more := batch.count()):
            return
        kept.grow("ids", more, lambda ids: ids.select("id", "key"))
        kept.grow("counts", more, _latest)
        known = kept.read("ids", kept.touched("ids", batch))
        fresh = staged(batch.join(known.select("id"), "id", "left_anti"), "fresh")
        new = fresh.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("at", kept.bucket("counts"))
        new = staged(new, "new")
        touched = {b: n for b, n in new.groupBy("at").count().collect()}
        whole = kept.outgrown("counts", touched)
        old = _latest(kept.read("counts", list(touched)))
        both = old.join(new, "key", "full_outer").select(
            "key", "n",
            (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"),
            F.least("first_id", "least").alias("first_id"),
        )
        kept.write("counts", both.filter(F.col("n").isNotNull() | kept.bucket("counts").isin(whole)), whole)
        kept.write("ids", fresh)
        kept.commit()
        for done in (batch, fresh, new):
            discard(done)

    def counts(self) -> DataFrame:
        """(key, copies, first_id), valid until the next add()."""
        return _latest(self.kept.read("counts"))

    def copies(self) -> DataFrame:
        """(first_id, copy_id) of each record that is a copy of one with a smaller id."""
        hot = self.counts().filter("copies > 1")
        return self.kept.read("ids").select("id", "key").join(hot, "key").filter("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def in_batches(df: DataFrame, order: str, batches: int) -> list[DataFrame]:
    """df in `batches` parts of about the same size by a time; null times come last."""
    seconds = F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    cuts = df.select(seconds.alias("t")).approxQuantile("t", [k / batches for k in range(1, batches)], 0.02) if batches > 1 else []
    if len(cuts) < batches - 1:
        return [df]
    part = F.lit(0)
    for c in cuts:
        part = part + F.when(seconds <= c, 0).otherwise(1)
    return [df.filter(part == k) for k in range(batches)]


def formatting_ledger(df: DataFrame, key: str, text: str, entries: str, order: str, batches: int = 3, path: str | None = None, rows: int = ROWS) -> Ledger:
    """A ledger of df, taken in by batches in the order of a time column. Records with a null key, and those without a
    letter or digit in the text, are left out; other columns are ignored, an empty table gives an empty ledger. A path that
    holds a ledger goes on with it."""
    ledger = Ledger(df.sparkSession, path, rows)
    keyed = df.select(F.col(key).alias("id"), canonical_key(F.col(text), F.col(entries)).alias("key"), F.col(order).alias("at"))
    for batch in in_batches(keyed, "at", batches):
        ledger.add(batch.select("id", "key"))
    return ledger
