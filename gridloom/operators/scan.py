"""Exponential smoothing as a scan of affine maps.

A step ``level -> (1 - alpha) * level + alpha * y`` is an affine map, and maps
compose, so a long series can be smoothed in blocks: within a block a running
sum of values weighted by their age, between blocks the composed maps, added up
by doubled steps. No value is left out: what a later step would still add
weighs less than the smallest double.
"""

from __future__ import annotations

from math import ceil, log2, log10

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranges import UPTO, joined, keyed

#: Decimal digits by which weights may differ within a block, and those of all doubles.
SPREAD, DIGITS = 150, 330
LONGEST = 1024


def smoothed(rows: DataFrame, group: list[str], pos: str, value: str, alpha: float, out: str) -> DataFrame:
    """Add ``out``, the smoothed level of the values before each row; null at the first.

    ``pos``: the row's place in its group, from 0 without gaps. The level begins
    with the first value. Values must not be null.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    keep = 1.0 - alpha
    fall = -log10(keep)
    block = max(1, min(LONGEST, int(SPREAD / fall)))
    power = lambda e: F.pow(F.lit(keep), e.cast("double"))
    place = F.pmod(F.col(pos), F.lit(block))
    rows = rows.withColumns({"scan_block": F.floor(F.col(pos) / F.lit(block)), "scan_y": F.when(F.col(pos) == 0, F.col(value)).otherwise(F.lit(alpha) * F.col(value))})
    rows = rows.withColumn("scan_key", keyed(*group, "scan_block")).drop("scan_block")
    # the map of a whole block: (scan_a, scan_b); the first block begins with a value, so its map is constant
    maps = rows.groupBy("scan_key").agg(F.sum(F.col("scan_y") * power(F.lit(block - 1) - place)).alias("scan_b")).withColumn("scan_a", F.when(F.col("scan_key.scan_block") == 0, 0.0).otherwise(F.lit(keep**block)))
    maps = maps.select("*", "scan_key.*")
    keys = ["scan_key", *group, "scan_block"]
    w = Window.partitionBy(*group).orderBy("scan_block")
    for step in range(max(0, ceil(log2(DIGITS / (block * fall))))):
        before = lambda c, s=2**step: F.lag(c, s).over(w)
        maps = maps.select(*keys, F.coalesce(F.col("scan_a") * before("scan_b"), F.lit(0.0)).alias("more"), "scan_b", (F.col("scan_a") * F.coalesce(before("scan_a"), F.lit(1.0))).alias("scan_a"))
        maps = maps.select(*keys, (F.col("scan_b") + F.col("more")).alias("scan_b"), "scan_a")
    starts = maps.select("scan_key", F.lag("scan_b").over(w).alias("scan_start"))
    own = Window.partitionBy("scan_key").orderBy(pos).rowsBetween(*UPTO)
    here = F.sum(F.col("scan_y") * power(-place)).over(own) * power(place - 1)
    level = F.when(F.col(pos) > 0, F.coalesce(F.col("scan_here"), F.lit(0.0)) + F.coalesce(F.col("scan_start"), F.lit(0.0)) * power(place))
    return joined(rows.withColumn("scan_here", here), starts, "scan_key").withColumn(out, level).drop("scan_key", "scan_y", "scan_here", "scan_start")
