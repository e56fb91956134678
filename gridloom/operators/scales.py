"""Scaling by figures of the whole table: one row of aggregates meets every row, never a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import ratio


def with_totals(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Add figures of the whole table to every row. The broadcast side is one row."""
    one = df.agg(*(a.alias(n) for n, a in aggregates.items()))
    return df.crossJoin(F.broadcast(one))


def share_of_max(df: DataFrame, columns: list[str], prefix: str = "max_") -> DataFrame:
    """Add the largest value of each column."""
    return with_totals(df, **{f"{prefix}{c}": F.max(c) for c in columns})


def percent_of_max(column: str, prefix: str = "max_") -> Column:
    return F.lit(100.0) * ratio(column, f"{prefix}{column}")


def min_max(df: DataFrame, columns: list[str], suffix: str = "_mm") -> DataFrame:
    """Each column from 0 to 100 over all rows; 50 where all are equal."""
    wide = with_totals(df, **{f"lo_{c}": F.min(c) for c in columns}, **{f"hi_{c}": F.max(c) for c in columns})
    out = wide.withColumns({f"{c}{suffix}": F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), F.lit(50.0)).otherwise(F.lit(100.0) * (F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0))) for c in columns})
    return out.drop(*(f"{p}_{c}" for c in columns for p in ("lo", "hi")))


def min_max_within(column: str, group: list[str], epsilon: float = 1e-9) -> Column:
    """From 0 to 100 within a group of rows."""
    w = Window.partitionBy(*group)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.lit(100.0) * (F.col(column) - low) / (high - low + F.lit(epsilon))
