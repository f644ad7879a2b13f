"""Writers of one file for each row: prompts, annotated documents, kept crash files. Tasks write side by side, each its own rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def renamed(rel: str, suffix: str) -> F.Column:
    """A relative path with another suffix."""
    return F.concat(F.regexp_replace(F.col(rel), r"\.[^./]*$", ""), F.lit(suffix))


def write_each(df: DataFrame, name: str, text: str, folder: str) -> DataFrame:
    """Writes the text of each row into `folder`, which all executors share, under the row's relative name; gives (name, bytes) of what
    was written. Rows with a null name or text, and names that would leave the folder, are left out. Of rows of one name the
    greatest text is written, so a task that runs again writes the same."""
    safe = ~F.col("name").rlike(r"(^|/)\.\.(/|$)|^/|^$|\n")
    rows = df.select(F.col(name).alias("name"), F.col(text).cast("binary").alias("text")).filter("name is not null and text is not null").filter(safe)
    one = rows.groupBy("name").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        made = set()
        for b in batches:
            texts = b.column(1).to_pylist()
            for rel, content in zip(b.column(0).to_pylist(), texts):
                path = f"{base}/{rel}"
                if (parent := path.rsplit("/", 1)[0]) not in made:
                    where.create_dir(parent, recursive=True)
                    made.add(parent)
                with where.open_output_stream(path) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64())], ["name", "bytes"])

    return one.mapInArrow(run, "name string, bytes bigint")


def drop_each(df: DataFrame, name: str, folder: str) -> DataFrame:
    """Deletes the files of `folder` that the rows name; gives (name, dropped). Names that would leave the folder are left out."""
    safe = ~F.col("name").rlike(r"(^|/)\.\.(/|$)|^/|^$|\n")
    rows = df.select(F.col(name).alias("name")).filter("name is not null").filter(safe).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            done = []
            for rel in b.column(0).to_pylist():
                there = where.get_file_info(f"{base}/{rel}").type == fs.FileType.File
                if there:
                    where.delete_file(f"{base}/{rel}")
                done.append(there)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.bool_())], ["name", "dropped"])

    return rows.mapInArrow(run, "name string, dropped boolean")
