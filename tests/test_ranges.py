"""Work on long groups in pieces, against the plain windows and a plain walk."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import quantiles, ranges, scan

START = dt.datetime(2023, 1, 1)


@pytest.fixture(scope="module")
def hours(spark):
    """One long group, short ones, one without a name, with gaps in time."""
    rng = random.Random(2)
    rows = [("long", START + dt.timedelta(hours=2 * i + (i // 500) * 900), i % 3, rng.random() * 9) for i in range(6000)]
    rows += [(f"g{g}", START + dt.timedelta(hours=i), 0, rng.random()) for g in range(30) for i in range(g)]
    rows += [(None, START + dt.timedelta(days=i), 1, float(i)) for i in range(40)]
    return spark.createDataFrame(rows, "name string, ts timestamp, kind int, x double").repartition(5).cache()


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)) for a, b in zip(g, w, strict=True)), (g, w)


def test_places(hours):
    w = Window.partitionBy("name").orderBy("ts")
    got = ranges.positions(hours, ["name"], ranges.month("ts"), ["ts"], "pos", "n")
    want = hours.withColumns({"pos": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("name"))})
    same(got.select(want.columns).collect(), want.collect())


@pytest.mark.parametrize(("back", "ahead", "block"), [(719, 0, 500), (5, 3, 7), (0, 47, 4096), (24, 0, 10)])
def test_row_frames_equal_the_plain_window(hours, back, ahead, block):
    frames = {
        "mean": lambda w: F.avg("x").over(w.rowsBetween(-back, ahead)), "n": lambda w: F.count("x").over(w.rowsBetween(-back, ahead)),
        "top": lambda w: F.max("kind").over(w.rowsBetween(-(back // 2), ahead)), "last": lambda w: F.lag("x", min(back, 1)).over(w),
    }
    got = ranges.windowed(hours, ["name"], ranges.month("ts"), ["ts"], frames, back, ahead, block)
    w = Window.partitionBy("name").orderBy("ts")
    want = hours.select("*", *(make(w).alias(name) for name, make in frames.items()))
    assert got.columns == want.columns
    same(got.collect(), want.collect())


def test_no_window_holds_a_whole_group(hours):
    """The plan's windows are by cell or by block; none is by the group alone but that over cells' counts."""
    out = ranges.windowed(hours, ["name"], ranges.month("ts"), ["ts"], {"s": lambda w: F.sum("x").over(w.rowsBetween(-719, 0))}, 719, 0, 500)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    alone = [x for x in plan.split("\n") if "Window [" in x and "halo_block" not in x and "range_cell" not in x]
    assert not alone


def test_runs_merge_across_cells(spark):
    rng = random.Random(4)
    rows = []
    for k in range(4):
        at = START + dt.timedelta(days=25)
        for _ in range(300):
            at += dt.timedelta(hours=rng.choice([1, 1, 1, 2, 5, 30]))
            rows.append((f"k{k}", at))
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    w = Window.partitionBy("key").orderBy("ts")
    begins = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > 7200 * 1_000_000).cast("int"), F.lit(1))
    want = df.withColumn("b", begins).withColumn("island", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("b")
    got = ranges.islands(df, ["key"], ranges.month("ts"), "ts", 7200)
    same(got.collect(), want.collect())
    over = want.groupBy("key", "island").agg(F.countDistinct(F.date_trunc("month", "ts")).alias("m")).where("m > 1").count()
    assert over > 0  # runs that go on in the next month


@pytest.mark.parametrize("alpha", [0.35, 0.9, 0.02, 0.0005])
def test_smoothing_equals_the_walk(spark, alpha):
    rng = random.Random(int(alpha * 1000))
    values = [rng.random() * 100 - 20 for _ in range(20_000)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)] + [("t", i, v) for i, v in enumerate(values[:3])], "name string, pos long, y double")
    got = {(r.name, r.pos): r.level for r in scan.smoothed(df, ["name"], "pos", "y", alpha, "level").collect()}
    level = None
    for i, v in enumerate(values):
        assert (got["s", i] is None) if level is None else math.isclose(got["s", i], level, rel_tol=1e-9, abs_tol=1e-9)
        level = v if level is None else alpha * v + (1 - alpha) * level
    assert got["t", 0] is None and got["t", 1] == values[0]


def test_smoothing_of_a_hundred_thousand_rows(spark):
    df = spark.range(100_000).select(F.lit("s").alias("name"), F.col("id").alias("pos"), (F.sin(F.col("id") * 0.37) * 50 + F.pmod(F.col("id") * 7919, F.lit(101))).alias("y"))
    got = [r.level for r in scan.smoothed(df, ["name"], "pos", "y", 0.35, "level").orderBy("pos").select("level").collect()]
    values = [r.y for r in df.orderBy("pos").collect()]
    level = values[0]
    for i in range(1, len(values)):
        assert math.isclose(got[i], level, rel_tol=1e-9, abs_tol=1e-9)
        level = 0.35 * values[i] + 0.65 * level


def test_quantiles_of_very_many_groups_and_a_hot_one(spark):
    hot = spark.range(150_000).select(F.lit(-1).alias("g"), F.sin(F.col("id").cast("double")).alias("v"))
    many = spark.range(400_000).select(F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("int").alias("g"), F.when(F.col("id") % 11 > 0, F.floor(F.rand(3) * 50) / 7).alias("v"))
    df = hot.unionByName(many).union(spark.createDataFrame([(None, 1.0), (None, 4.0), (-2, None)], "g int, v double")).cache()
    shares = {"low": 0.0, "middle": 0.5, "p95": 0.95, "high": 1.0}
    got = quantiles.quantiles(df, ["g"], "v", shares)
    want = df.where("v is not null").groupBy("g").agg(*(F.percentile("v", q).alias(k) for k, q in shares.items()))
    off = got.join(want.select(F.col("g").alias("h"), *(F.col(k).alias(f"w_{k}") for k in shares)), F.col("g").eqNullSafe(F.col("h")), "full")
    wrong = " or ".join(f"{k} is null or w_{k} is null or abs({k} - w_{k}) > 1e-9" for k in shares)
    assert off.where(wrong).count() == 0 and got.count() == want.count() > 90_000
    added = quantiles.group_percentile(df, "g", "v", 0.5, "middle")
    assert added.count() == df.count() and added.where("g = -2 and middle is null").count() == 1


def test_rows_are_shuffled_once_for_their_places(spark, hours):
    """Window, counts and join go by one key: one shuffle of the rows, two of the cells' counts by it and one by group."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = ranges.positions(hours, ["name"], ranges.month("ts"), ["ts"], "pos", "n")
        smooth = scan.smoothed(placed.where("x is not null"), ["name"], "pos", "x", 0.35, "level")
        for df, n in ((placed, 4), (smooth, 4 + 4 + 4)):  # the scan reads the places twice: for its maps and for its rows
            plan = df._jdf.queryExecution().sparkPlan().toString()
            exchanges = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
            assert "coalesce(" not in " ".join(x for x in plan.split("\n") if "SortMergeJoin" in x)
            assert len(exchanges) == n, exchanges
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
