"""Numbers in the order of a whole table, without one task for all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[Column], once: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """Add ``out``, each row's place (from 1) in ``order``, which should leave no ties.

    The rows are dealt by ranges of the order and stored with the number of
    their range by ``once``; places within a range are counted there, and only
    the ranges' sizes meet.
    """
    ranged = df.repartitionByRange(*order).withColumn("order_range", F.spark_partition_id())
    placed = once(ranged)
    sizes = placed.groupBy("order_range").agg(F.count(F.lit(1)).alias("order_size"))
    before = F.coalesce(F.sum("order_size").over(Window.orderBy("order_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("order_range", before.alias("order_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("order_range").orderBy(*order))
    return placed.withColumn(out, own).join(F.broadcast(bases), "order_range").withColumn(out, F.col(out) + F.col("order_before")).drop("order_range", "order_before")
