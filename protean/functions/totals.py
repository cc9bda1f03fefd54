"""Running totals over a whole table, without a window that puts all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def running(df: DataFrame, order: list, value, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (a column expression, null: 0) over the rows before, in ``order``.

    Rows are range-partitioned and summed within each partition; the partitions' own totals, one row
    each, give where it begins. ``order`` must tell rows apart where the result is to be the same in
    every run. The ranges are written once, so that both passes see the same ones.
    """
    at = cut(df.withColumn("_v", F.coalesce(value, F.lit(0))).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = at.groupBy("_part").agg(F.sum("_v").alias("_t"))
    starts = totals.select("_part", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    within = F.sum("_v").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = at.withColumn("_in", F.coalesce(within, F.lit(0))).join(F.broadcast(starts), "_part")  # a row for each partition
    return out.withColumn(name, F.col("_from") + F.col("_in")).drop("_part", "_v", "_in", "_from")
