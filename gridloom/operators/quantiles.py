"""Exact quantiles of very many or very large groups, by the places of their values.

Equal values are counted where the rows are. The counted values are dealt by
ranges of (group, value), so many small groups share a task and a large one
spans several; a range's sums per group give the places at which it begins. The
values at the wanted places are then at hand: no task holds a group's values
and no group's figures are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranges import ALL, UPTO, joined, keyed
from gridloom.sources.shared import stored

Once = Callable[[DataFrame, str], DataFrame]


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float], once: Once | None = None) -> DataFrame:
    """``group`` with a column for each of ``shares`` (name: share), interpolated between neighbours; nulls don't count.

    A group without values has no row. ``once`` stores what two plans read.
    """
    once = once or (lambda d, label: stored(d, label)[0])
    counts = df.select(*group, F.col(value).cast("double").alias("v")).where("v is not null").groupBy(*group, "v").agg(F.count(F.lit(1)).alias("times"))
    ranged = once(counts.repartitionByRange(*(F.col(c).asc_nulls_first() for c in group), F.col("v")).withColumn("part", F.spark_partition_id()), "quantile_ranges")
    ranged = ranged.withColumn("part_key", keyed(*group, "part")).drop("part")
    w = Window.partitionBy(*group).orderBy("part")
    sizes = ranged.groupBy("part_key").agg(F.sum("times").alias("in_part")).select("part_key", "part_key.*", "in_part")
    bases = sizes.select("part_key", F.coalesce(F.sum("in_part").over(w.rowsBetween(*UPTO)), F.lit(0)).alias("before"), F.sum("in_part").over(w.rowsBetween(*ALL)).alias("n"))
    passed = F.sum("times").over(Window.partitionBy("part_key").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = joined(ranged.withColumn("upto", passed), bases, "part_key").withColumn("upto", F.col("upto") + F.col("before")).withColumn("since", F.col("upto") - F.col("times"))
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    at = lambda p: F.max(F.when((p >= F.col("since")) & (p < F.col("upto")), F.col("v")))
    sides = rows.groupBy(*group).agg(F.max("n").alias("n"), *(at(side(place(q))).alias(f"{name}_{k}") for name, q in shares.items() for k, side in (("low", F.floor), ("high", F.ceil))))
    mixed = lambda name, q: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (place(q) - F.floor(place(q)))
    return sides.select(*group, *(mixed(name, q).alias(name) for name, q in shares.items()))


def group_percentile(df: DataFrame, group: str, value: str, share: float, out: str, once: Once | None = None) -> DataFrame:
    """Add ``out``, the exact percentile of ``value`` in each row's ``group``; null where the group has no value.

    The percentiles are stored, so that the join knows their size and leaves the rows where they are if that is small.
    """
    once = once or (lambda d, label: stored(d, label)[0])
    found = once(quantiles(df, [group], value, {out: share}, once).withColumnRenamed(group, "percentile_of"), "percentiles")
    return df.join(found, F.col(group).eqNullSafe(F.col("percentile_of")), "left").drop("percentile_of")
