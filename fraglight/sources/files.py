"""Readers and writers of source files, option files and iteration reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_files(spark: SparkSession, folder: str, glob: str = "*.rs", without: tuple[str, ...] = ()) -> DataFrame:
    """(path, rel, content, text, valid) of all files below a folder that aren't empty. text is the content with invalid UTF-8 replaced; valid
    tells whether there was none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    for part in without:
        files = files.filter(~F.contains("path", F.lit(part)))
    base = "/" + folder.removeprefix("file:").strip("/") + "/"
    return files.select("path", F.substring_index("path", base, -1).alias("rel"), "content", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.try_validate_utf8(F.col("content").cast("string")).isNotNull().alias("valid"))


def gathered(spark: SparkSession, file: str | None = None, folder: str | None = None, every: bool = False) -> DataFrame:
    """A file and all sources (or all files) of a folder; what both name is there twice."""
    out = None
    if file:
        out = spark.read.format("binaryFile").load(file)
    if folder:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        found = (read if every else read.option("pathGlobFilter", "*.rs")).load(folder)
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("a file or a folder is needed")
    return out


def options(spark: SparkSession, path: str) -> list[str]:
    """The flags of an option file, one for each line that isn't blank or a # comment. Raises on other lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not startswith(v, '#')")
    flags = [r[0] for r in lines.collect()]  # an option file is a few lines
    for f in flags:
        if not f.startswith("-") or "/" in f or "\\" in f:
            raise ValueError(f"not a flag: {f}")
    return flags


def next_iteration(spark: SparkSession, folder: str) -> int:
    """One more than the greatest N of the files iteration_N.txt, or 0."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/iteration_*.txt")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    numbers = [int(m[1]) for f in found if (m := re.search(r"iteration_(\d+)\.txt$", f.getPath().getName()))]
    return max(numbers, default=-1) + 1


def by_content(texts: DataFrame, text: str) -> DataFrame:
    """(id, text) of each distinct text; the id is a hash of the content."""
    return texts.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("id"), F.col(text).alias("text")).dropDuplicates(["id"])


def folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders right below a folder, in order."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(target) if x.isDirectory()) if files.exists(target) else []


def new_folders(before: list[str], after: list[str]) -> list[str]:
    """Those that came since."""
    return sorted(set(after) - set(before))
