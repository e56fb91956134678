"""Work on long ordered groups in pieces: places of rows, row frames with halo rows, sessions across borders.

A group (a feeder's or a substation's history, say) may be too long for one
task. It is split into ordered cells, such as months; rows are sorted within
their cell, and only a row for each cell meets per group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a block that a window works on, without its halo.
BLOCK = 4096
UPTO = (Window.unboundedPreceding, -1)
ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def month(at: str) -> Column:
    """Cells by month."""
    return F.date_trunc("month", F.col(at))


def keyed(*columns: str) -> Column:
    """Columns as one key that is never null, so that null parts meet by plain equality.

    A window, an aggregate and a join by one key share one shuffle of the rows;
    null-safe equality of the parts would deal them out anew.
    """
    return F.struct(*columns)


def joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the other columns of ``right``, of which there is one row for each ``key`` (see ``keyed``)."""
    other = right.withColumnRenamed(key, f"at_{key}")
    return left.join(other, F.col(key) == F.col(f"at_{key}")).drop(f"at_{key}")


def positions(df: DataFrame, group: list[str], cell: Column, order: list[str], out: str = "pos", total: str | None = None) -> DataFrame:
    """Add ``out``, each row's place (from 0) in its group by ``order``, which should leave no ties, and the group's size as ``total``.

    ``cell`` must not fall along ``order``. Nulls are a group and a cell of their own.
    """
    rows = df.withColumn("range_cell", cell).withColumn("range_cell_key", keyed(*group, "range_cell")).drop("range_cell")
    w = Window.partitionBy(*group).orderBy("range_cell")
    sizes = rows.groupBy("range_cell_key").agg(F.count(F.lit(1)).alias("range_n")).select("range_cell_key", "range_cell_key.*", "range_n")
    bases = sizes.select("range_cell_key", F.coalesce(F.sum("range_n").over(w.rowsBetween(*UPTO)), F.lit(0)).alias("range_before"), *([F.sum("range_n").over(w.rowsBetween(*ALL)).alias(total)] if total else []))
    placed = rows.withColumn(out, F.row_number().over(Window.partitionBy("range_cell_key").orderBy(*order)) - 1)
    return joined(placed, bases, "range_cell_key").withColumn(out, F.col(out) + F.col("range_before")).drop("range_cell_key", "range_before")


def windowed(df: DataFrame, group: list[str], cell: Column, order: list[str], frames: dict[str, Callable[[WindowSpec], Column]], back: int = 0, ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """Add columns over row frames of at most ``back`` rows before and ``ahead`` rows after each row.

    A group's rows are cut into blocks by their place; a block also gets the
    rows that its first and last rows look at (its halo), so no window is longer
    than ``block + back + ahead`` rows. The result is that of the plain window.
    """
    rows = positions(df, group, cell, order, "halo_pos", "halo_n").withColumn("halo_own", F.floor(F.col("halo_pos") / F.lit(block)))
    first = F.floor(F.greatest(F.col("halo_pos") - F.lit(ahead), F.lit(0)) / F.lit(block))
    last = F.floor(F.least(F.col("halo_pos") + F.lit(back), F.col("halo_n") - 1) / F.lit(block))
    spread = rows.withColumn("halo_block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*group, "halo_block").orderBy("halo_pos")
    out = spread.select(*df.columns, "halo_own", "halo_block", *(make(w).alias(name) for name, make in frames.items()))
    return out.where("halo_own = halo_block").drop("halo_own", "halo_block")


def islands(df: DataFrame, key: list[str], cell: Column, at: str, seconds: int, out: str = "island") -> DataFrame:
    """Number the runs of rows of a key that follow each other by no more than ``seconds``; from 1, across cells."""
    when = F.unix_micros(F.col(at).cast("timestamp"))
    rows = df.withColumn("range_cell", cell).withColumn("range_cell_key", keyed(*key, "range_cell")).drop("range_cell")
    own = Window.partitionBy("range_cell_key").orderBy(at)
    gap = when - F.lag(when).over(own)
    rows = rows.withColumn("range_begins", F.when(gap > seconds * 1_000_000, 1).otherwise(0))
    ends = rows.groupBy("range_cell_key").agg(F.min(when).alias("range_first"), F.max(when).alias("range_last"), F.sum("range_begins").alias("range_more")).select("*", "range_cell_key.*")
    w = Window.partitionBy(*key).orderBy("range_cell")
    # whether a cell's first row begins a run depends on the cell before
    since = F.col("range_first") - F.lag("range_last").over(w)
    ends = ends.withColumn("range_new", F.when(since.isNull() | (since > seconds * 1_000_000), 1).otherwise(0))
    ends = ends.withColumn("range_base", F.sum("range_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("range_more").over(w.rowsBetween(*UPTO)), F.lit(0)))
    numbered = rows.withColumn("range_here", F.sum("range_begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out_rows = joined(numbered, ends.select("range_cell_key", "range_base"), "range_cell_key")
    return out_rows.withColumn(out, (F.col("range_base") + F.col("range_here")).cast("long")).select(*df.columns, out)
