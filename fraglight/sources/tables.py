"""Parquet tables of one data folder, and tables staged between the steps of a job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_shipped: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application: they needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="fraglight-package-")  # the driver's own; Spark serves the file from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, f"{package.name}/{file.relative_to(package)}")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Only where it is unset (tests on one
    machine) a temporary folder is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fraglight-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base[7:], ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet; local ones go when the driver ends."""
    base = shared_folder(spark)
    if base not in _folders:
        _folders[base] = f"{base.rstrip('/')}/fraglight-{uuid.uuid4().hex}"
        if base.startswith(("file:", "/")):
            local = "/" + _folders[base].removeprefix("file:").lstrip("/")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
    return f"{_folders[base]}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df as a table into the shared folder and reads it back. This cuts the lineage, and the table outlives the
    executors that wrote it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    drop_path(df.sparkSession, df.staged_at)


def _files(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def drop_path(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


def path_names(spark: SparkSession, path: str, start: str = "") -> list[str]:
    """Names of what a folder holds that begin so; none if it isn't there."""
    files, target = _files(spark, path)
    if not files.exists(target):
        return []
    return [n for x in files.listStatus(target) if (n := x.getPath().getName()).startswith(start)]
