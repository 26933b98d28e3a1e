"""Positions in a global order without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.tables import stored


def with_position(df: DataFrame, keys: list[Column], name: str = "_pos") -> DataFrame:
    """Adds the 0-based position of each row in the order of keys.

    Rows are range-partitioned and sorted within partitions; the partitions' row counts (one row each, so
    as many as there are partitions) give each its offset. The sorted table is stored, since its partitions must not change between the
    count and the use.
    """
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    made = stored(parts.withColumn("_id", F.monotonically_increasing_id()), "order")
    part = F.shiftright(F.col("_id"), 33)
    sizes = made.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return made.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_start") + local).drop("_id", "_part", "_start")
