"""Numbers in order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraglight.sources.tables import staged


def indexed(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "idx") -> DataFrame:
    """df with a number from 0 on, by `order` within each value of `by`. Rows are range-partitioned by both, so a hot value is
    split; the parts' sizes, one row for each part and value, give the offsets."""
    by = by or []
    part = staged(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1
    sizes = part.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    keys = ["_part", *by]
    same = F.lit(True)
    numbered = part.withColumn("_in", inside)
    for k in keys:
        same = same & numbered[k].eqNullSafe(sizes[k])
    joined = numbered.join(sizes, same)
    return joined.select(*(numbered[c] for c in df.columns), (F.col("_in") + F.col("_before")).cast("bigint").alias(name))


def pick(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 of a key; the same in every run and in SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")
