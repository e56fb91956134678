"""Differences of two written tables with a common key, by row checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAME, CHANGED, LEFT, RIGHT = "same", "changed", "left_only", "right_only"


def compared(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """``keys`` and ``status`` of every row of either table: the same, changed, or in one alone.

    Only keys and a checksum of the compared columns are shuffled. A key on
    several rows is compared as the sum of its rows' checksums and their number;
    null keys meet.
    """
    columns = columns or [c for c in left.columns if c not in keys and c in right.columns]

    def summed(df: DataFrame, n: str, h: str) -> DataFrame:
        # nulls don't count in a checksum, so each value goes with whether there is one
        row = F.xxhash64(*(x for c in columns for x in (F.col(c), F.col(c).isNull())), F.lit(0)).cast("decimal(38,0)")
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.sum(row).alias(h))

    a, b = summed(left, "n_left", "h_left"), summed(right, "n_right", "h_right")
    other = b.select(*(F.col(k).alias(f"right_{k}") for k in keys), "n_right", "h_right")
    on = [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys]
    both = a.join(other, on, "full")
    status = F.when(F.col("n_right").isNull(), LEFT).when(F.col("n_left").isNull(), RIGHT).when((F.col("n_left") == F.col("n_right")) & (F.col("h_left") == F.col("h_right")), SAME).otherwise(CHANGED)
    return both.select(*(F.when(F.col("n_left").isNotNull(), F.col(k)).otherwise(F.col(f"right_{k}")).alias(k) for k in keys), status.alias("status"))


def correlations(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """The matrix of correlations as rows ``a, b, n, r``, in one pass; a pair counts the rows in which both are there, and
    one whose column doesn't vary has no correlation (null). Every pair is a co-moment that partitions add up on their own.
    """
    group = group or []
    x = {c: F.col(c).cast("double") for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def of(a: str, b: str) -> tuple[Column, Column]:
        p, q = F.when(x[b].isNotNull(), x[a]), F.when(x[a].isNotNull(), x[b])
        return F.count(F.when(p.isNotNull() & q.isNotNull(), 1)), F.covar_pop(p, q) / F.nullif(F.stddev_pop(p) * F.stddev_pop(q), F.lit(0.0))

    one = df.groupBy(*group).agg(*(f.alias(f"{kind}_{i}") for i, (a, b) in enumerate(pairs) for kind, f in zip("nr", of(a, b), strict=True)))
    cells = [F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"n_{i}").alias("n"), F.col(f"r_{i}").alias("r")) for i, (a, b) in enumerate(pairs) for p, q in dict.fromkeys([(a, b), (b, a)])]
    return one.select(*group, F.explode(F.array(*cells)).alias("cell")).select(*group, "cell.*")
