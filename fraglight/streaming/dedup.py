"""Places seen for the first time, over a stream of files, with state that outlives the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraglight.sources.tables import new_path


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of the files of a table, which may be one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    folder = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def first_seen(stream: DataFrame, keys: list[str], checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Runs over all that the stream has now and gives every distinct key once. Keys are few by nature (distinct crash places),
    so the state has no watermark. With the same checkpoint and out a later call goes on where this one ended."""
    spark = stream.sparkSession
    out = out or new_path(spark, "firsts")
    checkpoint = checkpoint or new_path(spark, "stream")
    query = (
        stream.select(*keys)
        .dropDuplicates(keys)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.select(*keys).schema).parquet(out)


def exploded(stream: DataFrame, list_column: str, name: str, *keep: str) -> DataFrame:
    return stream.select(*keep, F.explode(list_column).alias(name)).filter(F.col(name).isNotNull())
