"""Event intervals: hourly series, overlap joins and sums without the pairs, islands of consecutive rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranges import UPTO, joined, keyed


def hourly(df: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """A row for each hour from ``start`` to ``end``, both included, counted from ``start``; reversed or null ends give none."""
    fits = F.col(end) >= F.col(start)
    return df.where(fits).withColumn(out, F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))))


def overlapping(left: DataFrame, right: DataFrame, key: str, how: str = "left", slack: str = "INTERVAL 0 HOURS", days: int = 1) -> DataFrame:
    """Intervals ``ts_start .. ts_end`` of ``left`` with those of ``right`` of equal ``key`` that they overlap.

    The right end is moved by ``slack``. Both sides are dealt to the buckets of
    ``days`` days that they touch, so a key with a long history meets only what
    is near it; a pair is kept in the later of its first buckets, once. The
    right side's columns get the prefix ``r_``.
    """
    if days < 1:
        raise ValueError("a bucket has at least one day")
    width = F.lit(86_400 * days)
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000) / width).cast("long")
    l, r = left.withColumn("l_first", bucket(F.col("ts_start"))), right
    r = r.withColumn("ts_end", F.col("ts_end") + F.expr(slack))
    r = r.select(*(F.col(c).alias(f"r_{c}") for c in r.columns)).withColumn("r_first", bucket(F.col("r_ts_start")))
    r = r.where("r_ts_end >= r_ts_start").withColumn("bucket", F.explode(F.sequence("r_first", bucket(F.col("r_ts_end")))))
    fits = F.col("ts_end") >= F.col("ts_start")
    touched = l.where(fits).withColumn("bucket", F.explode(F.sequence("l_first", bucket(F.col("ts_end")))))
    near = touched.join(r, (F.col(key) == F.col(f"r_{key}")) & (touched.bucket == r.bucket) & (F.col("r_ts_start") <= F.col("ts_end")) & (F.col("r_ts_end") >= F.col("ts_start")) & (r.bucket == F.greatest("l_first", "r_first")))
    pairs = near.drop("bucket", "l_first", "r_first")
    return pairs if how == "inner" else pairs.unionByName(left.join(pairs, [c for c in left.columns], "left_anti"), allowMissingColumns=True)


def overlap_sums(left: DataFrame, right: DataFrame, key: str, row: str, sums: dict[str, Column], slack: str = "INTERVAL 0 HOURS") -> DataFrame:
    """``row`` of each interval of ``left`` with ``sums`` over the rows of ``right`` that ``overlapping`` would pair it with; the pairs, which grow with both sides, aren't made.

    What begins up to an interval's end, less what ends before it begins, is
    what it overlaps. Both are running sums in order of time, taken within days
    and carried on from day to day, so no task holds a key's history. The
    columns of ``sums`` should be whole or decimal numbers, whose differences are exact.
    """
    fits = F.col("ts_end") >= F.col("ts_start")
    r = right.withColumn("ts_end", F.col("ts_end") + F.expr(slack)).where(fits)
    # side 0: begins of the right by ends of the left; side 1: ends of the right by begins of the left. Equal times meet: a begin counts before it is asked for, an end after
    at = lambda first, second: F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(first).alias("at")), F.struct(F.lit(1).alias("side"), F.col(second).alias("at")))).alias("p")
    steps = r.select(F.col(key).alias("key"), at("ts_start", "ts_end"), *(F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items())).select("key", "p.*", F.col("p.side").alias("late"), F.lit(False).alias("asked"), *sums)
    asked = left.where(fits).select(F.col(key).alias("key"), at("ts_end", "ts_start"), F.col(row).alias("row")).select("key", "p.*", (1 - F.col("p.side")).alias("late"), F.lit(True).alias("asked"), "row")
    rows = steps.unionByName(asked, allowMissingColumns=True).where("key IS NOT NULL").withColumn("day", F.date_trunc("day", "at")).withColumn("day_key", keyed("key", "side", "day"))
    days = rows.where("NOT asked").groupBy("day_key").agg(*(F.sum(n).alias(n) for n in sums))
    days = days.unionByName(rows.where("asked").select("day_key").distinct(), allowMissingColumns=True).groupBy("day_key").agg(*(F.sum(n).alias(n) for n in sums)).select("day_key", "day_key.*", *sums)
    w = Window.partitionBy("key", "side").orderBy("day").rowsBetween(*UPTO)
    bases = days.select("day_key", *(F.sum(n).over(w).alias(f"base_{n}") for n in sums))
    own = Window.partitionBy("day_key").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    known = joined(rows.select("day_key", "side", "row", "asked", *(F.sum(n).over(own).alias(n) for n in sums)).where("asked"), bases, "day_key")
    zero = F.lit(0)
    upto = lambda n: F.coalesce(n, zero) + F.coalesce(f"base_{n}", zero)
    return known.groupBy(F.col("row").alias(row)).agg(*(F.sum(F.when(F.col("side") == 0, upto(n)).otherwise(-upto(n))).alias(n) for n in sums))


def overlap_figures(left: DataFrame, right: DataFrame, key: str, row: str, other: str, rank: str, amount: str, slack: str = "INTERVAL 0 HOURS", ranks: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """What the intervals of each ``row`` overlap: different ``other`` (``n_met``), the largest ``rank`` (``top``, one of ``ranks``) and the sum of ``amount`` (``total``).

    Only rows whose ``row`` or ``other`` stands in several rows are paired, so that
    they count once, and those whose amount is no number that a decimal can hold.
    """
    l, r = left.select(row, key, "ts_start", "ts_end"), right.select(other, key, "ts_start", "ts_end", rank, amount)
    fitting = F.col(amount).isNull() | (F.abs(F.col(amount).cast("double")) < 1e15)
    l_again = l.groupBy(row).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(row)
    r_again = r.groupBy(other).agg(F.count(F.lit(1)).alias("n"), F.min(fitting).alias("fits")).where("n > 1 OR NOT fits").select(other)
    l_once, r_once = l.join(l_again, row, "left_anti"), r.join(r_again, other, "left_anti")
    counted = lambda c: F.when(c, 1).otherwise(0)
    sums = {"n_met": counted(F.col(other).isNotNull()), **{f"rank_{x}": counted(F.col(rank) == x) for x in ranks}, "total": F.col(amount).try_cast("decimal(28,12)")}
    swept = overlap_sums(l_once, r_once, key, row, sums, slack)
    top = F.greatest(F.lit(None).cast("int"), *(F.when(F.col(f"rank_{x}") > 0, x) for x in ranks))
    swept = swept.select(row, "n_met", top.alias("top"), F.col("total").cast("double").alias("total"))
    pairs = overlapping(l.join(l_again, row, "left_semi"), r, key, "inner", slack).unionByName(overlapping(l_once, r.join(r_again, other, "left_semi"), key, "inner", slack))
    paired = pairs.groupBy(row).agg(F.countDistinct(f"r_{other}").alias("n_met"), F.max(f"r_{rank}").alias("top"), F.sum(f"r_{amount}").alias("total"))
    return swept.unionByName(paired).groupBy(row).agg(F.sum("n_met").alias("n_met"), F.max("top").alias("top"), F.sum("total").alias("total"))


def overlapping_ids(left: DataFrame, right: DataFrame, key: str, row: str, slack: str = "INTERVAL 0 HOURS") -> DataFrame:
    """The rows of ``left`` (``row`` tells them apart) that overlap any row of ``right`` of equal ``key``."""
    met = overlap_sums(left.select(row, key, "ts_start", "ts_end"), right.select(key, "ts_start", "ts_end"), key, row, {"n_met": F.lit(1)}, slack)
    return left.join(met.where("n_met > 0").select(row), row, "left_semi")


def islands(df: DataFrame, key: list[str], at: str, seconds: int, out: str = "island") -> DataFrame:
    """Number the runs of rows of a key that follow each other by no more than ``seconds``; from 1."""
    w = Window.partitionBy(*key).orderBy(at)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    begins = F.when(gap.isNull() | (gap > seconds * 1_000_000), 1).otherwise(0)
    return df.withColumn("begins", begins).withColumn(out, F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("begins")
