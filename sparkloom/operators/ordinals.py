"""Row numbers over a whole frame without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.storage import table


def dense_order(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in order of ``keys`` (made unique by the caller).

    Range partitions are written, numbered on their own, and the counts of the partitions
    before, one row each, are added. No task sees more than its range.
    """
    ranged = table(df.repartitionByRange(*(F.col(k) for k in keys)).withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1)
    sizes = ranged.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return inside.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_row") + F.col("_before")).cast("long")).drop("_part", "_row", "_before")
