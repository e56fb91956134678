"""Hand-made inputs on which engines or habits differ."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions.exprs import boundaries, last_wins, ratio, risk_tier, round_away, urgency_tier
from gridloom.operators import anomalies
from gridloom.operators.intervals import hourly, islands, overlap_figures, overlapping, overlapping_ids
from gridloom.operators.quantiles import group_percentile, quantiles
from gridloom.operators.ranking import numbered
from gridloom.operators.scales import min_max
from gridloom.plans import q_board, q_checks

T = lambda h, m=0, s=0: dt.datetime(2024, 1, 1, h, m, s)
SPAN = "id int, key int, ts_start timestamp_ntz, ts_end timestamp_ntz"


def one(df):
    return df.first()[0]


def test_boundaries_not_units(spark):
    df = spark.createDataFrame([(T(0, 59), T(1, 1)), (T(0, 0, 59), T(0, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert [tuple(r) for r in df.select(boundaries("hour", "a", "b"), boundaries("minute", "a", "b")).collect()] == [(1, 2), (0, 1)]


def test_hours_of_an_interval(spark):
    df = spark.createDataFrame([(1, 1, T(0, 20), T(2, 10)), (2, 1, T(2, 20), T(0, 10)), (3, 1, T(5), None)], SPAN)
    assert [(r.id, r.at) for r in hourly(df, "ts_start", "ts_end", "at").collect()] == [(1, T(0, 20)), (1, T(1, 20))]


def test_rounding(spark):
    x = [(1.005, 2, 1.0), (0.125, 2, 0.13), (2.5, 0, 3.0), (-2.5, 0, -3.0)]
    for v, digits, want in x:
        assert one(spark.range(1).select(round_away(F.lit(v), digits))) == want


def test_single_rows_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "v double")
    assert abs(one(df.agg(F.percentile("v", 0.95))) - 9.2) < 1e-12 and one(df.where("v = 1").agg(F.stddev_samp("v"))) is None
    assert one(spark.range(1).select(F.least(F.lit(1.0), F.lit(None).cast("double")))) == 1.0 and one(spark.range(1).select(ratio(F.lit(1.0), F.lit(0)))) is None
    assert {r.v_mm for r in min_max(spark.createDataFrame([(7.0,), (7.0,)], "v double"), ["v"]).collect()} == {50.0}


def test_overlap_with_and_without_slack(spark):
    left, right = spark.createDataFrame([(1, 1, T(10, 30), T(10, 45))], SPAN), spark.createDataFrame([(9, 1, T(10), T(10))], SPAN)
    assert overlapping(left, right, "key", "inner").count() == 0 and overlapping(left, right, "key", "inner", "INTERVAL 1 HOUR").count() == 1
    assert overlapping(left, right, "key", "left").first().r_id is None
    with pytest.raises(ValueError):
        overlapping(left, right, "key", days=0)


def test_overlapping_rows_by_brute_force(spark):
    rng = random.Random(5)
    span = lambda n: [(i, rng.randrange(4), (a := T(0) + dt.timedelta(minutes=rng.randrange(20_000))), a + dt.timedelta(minutes=rng.randrange(-60, 4000))) for i in range(n)]
    a, b = span(80), span(60)
    want = sorted(x[0] for x in a if x[3] >= x[2] and any(y[1] == x[1] and y[3] >= y[2] and y[2] <= x[3] and y[3] >= x[2] for y in b))
    assert sorted(r.id for r in overlapping_ids(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), "key", "id").collect()) == want


def test_overlap_figures_by_brute_force(spark):
    """Ends that touch, ids in several rows, null keys, ids and amounts, and amounts beyond decimals."""
    rng = random.Random(11)
    span = lambda: ((a := T(0) + dt.timedelta(minutes=30 * rng.randrange(300))), a + dt.timedelta(minutes=30 * rng.randrange(-2, 120)))
    a = [(rng.randrange(60), rng.choice([0, 1, 2, None]), *span()) for _ in range(90)]
    b = [(rng.choice([None, *range(120)]), rng.choice([0, 1, 2, None]), *span(), rng.choice([1, 2, 3, 4]), rng.choice([None, 0.1, 7.25, 1e300 if i == 5 else 3.0])) for i in range(90)]
    hour = dt.timedelta(hours=1)
    want = {}
    for x in a:
        for y in b:
            if x[1] is not None and x[1] == y[1] and x[3] >= x[2] and y[3] + hour >= y[2] and y[2] <= x[3] and y[3] + hour >= x[2]:
                want.setdefault(x[0], []).append(y)
    left, right = spark.createDataFrame(a, SPAN), spark.createDataFrame(b, "event int, key int, ts_start timestamp_ntz, ts_end timestamp_ntz, rank int, amount double")
    got = {r.id: r for r in overlap_figures(left, right, "key", "id", "event", "rank", "amount", "INTERVAL 1 HOUR").collect() if r.top}
    assert got.keys() == want.keys()
    for i, met in want.items():
        total = [y[5] for y in met if y[5] is not None]
        assert (got[i].n_met, got[i].top) == (len({y[0] for y in met if y[0] is not None}), max(y[4] for y in met)) and (got[i].total or 0.0) == pytest.approx(sum(total))


def test_overlaps_are_counted_without_their_pairs(spark):
    """20,000 intervals that each overlap 20,000 others: 400 million pairs."""
    n = 20_000
    spans = spark.range(n).select(F.col("id"), F.lit(1).alias("key"), (F.lit(T(0)) + F.make_dt_interval(secs=F.col("id"))).alias("ts_start"), (F.lit(T(0)) + F.expr("INTERVAL 9 HOURS")).alias("ts_end"), F.lit(2).alias("rank"), F.lit(0.5).alias("amount"))
    got = overlap_figures(spans, spans.withColumnRenamed("id", "event"), "key", "id", "event", "rank", "amount").groupBy("n_met", "top", "total").count().collect()
    assert [tuple(r) for r in got] == [(n, 2, n / 2, n)]


def test_islands(spark):
    df = spark.createDataFrame([(1, T(0)), (1, T(1)), (1, T(3))], "key int, at timestamp_ntz")
    assert [r.island for r in islands(df, ["key"], "at", 3600).orderBy("at").collect()] == [1, 1, 2]


def test_ladders(spark):
    rules = [(F.col("asset") >= 75, "replace"), (F.col("score") >= 90, "now"), (F.col("score") < 45, "watch")]
    df = spark.createDataFrame([(80, 92.0), (80, 40.0), (80, 60.0), (10, 60.0)], "asset int, score double")
    assert [r.x for r in df.select(last_wins(F.lit("usual"), rules).alias("x")).collect()] == ["now", "watch", "replace", "usual"]
    tiers = spark.createDataFrame([(v,) for v in (39.99, 40.0, 60.0, 80.0, 54.99, 55.0, 70.0, 85.0)], "v double").select(risk_tier("v"), urgency_tier("v")).collect()
    assert [r[0] for r in tiers[:4]] == ["bajo", "medio", "alto", "critico"] and [r[1] for r in tiers[4:]] == ["monitorizacion", "planificada", "alta", "inmediata"]


def test_station_trend_fires_once(spark):
    hours = [(dt.date(2024, 1, 1) + dt.timedelta(days=d), 1, 1, 1.0 if d >= 30 else 0.1, False) for d in range(37)]
    got = anomalies.station_trend(spark.createDataFrame(hours, "day date, station_id long, zone_id long, load_ratio double, congested boolean")).collect()
    assert [r.day for r in got] == [dt.date(2024, 2, 6)] and got[0].observed == 1.0 and got[0].threshold < 1


def test_lights(spark):
    cases = [(0.9, "at most", "OK"), (1.2, "at most", "Vigilancia"), (1.21, "at most", "Crítico"), (1.0, "at least", "OK"), (0.8, "at least", "Vigilancia"), (0.79, "at least", "Crítico")]
    df = spark.createDataFrame([(v, rule) for v, rule, _ in cases], "v double, rule string")
    assert [r[0] for r in df.select(q_board.light(F.col("v"), F.lit(1.0), F.col("rule"))).collect()] == [c for _, _, c in cases]


def test_readiness(spark):
    issue = lambda *s: spark.createDataFrame([(x, 1) for x in s] + [("alta", 0)], "severity string, failed int")
    gate = lambda blocker, passed: spark.createDataFrame([(blocker, passed)], "blocker int, passed int")
    cases = [(("alta",), (0, 1), "FAIL", "publish-blocked"), (("media", "media"), (0, 1), "WARN", "publish-blocked"), (("media",), (0, 0), "WARN", "publish-with-caveats"), ((), (1, 1), "PASS", "publish-with-caveats"), ((), (1, 0), "PASS", "publish-blocked")]
    for found, (blocker, passed), status, publish in cases:
        r = q_checks.assessment(issue(*found), gate(blocker, passed)).first()
        assert (r.status, r.publish_state) == (status, publish)


@pytest.mark.parametrize("seed", [1, 7, 4096])
def test_quantiles_are_exact(spark, seed):
    rng = random.Random(seed)
    rows = [(g, x) for g in ("a", "b") for x in (rng.choice([rng.gauss(0, 5), float(rng.randrange(4))]) for _ in range(rng.randrange(300, 400)))] + [("one", 3.5), ("same", 2.0), ("same", 2.0), ("none", None)]
    got = {r.g: (r.middle, r.p99) for r in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"middle": 0.5, "p99": 0.99}).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = {g: (a, b) for g, a, b in con.execute("SELECT g, quantile_cont(v, 0.5), quantile_cont(v, 0.99) FROM t WHERE v IS NOT NULL GROUP BY 1").fetchall()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for g in want for x, y in zip(got[g], want[g], strict=True))


def test_group_percentile(spark):
    df = spark.createDataFrame([(1, 5.0)] * 99 + [(1, 9.0)] + [(2, None), (2, 1.0)], "g int, v double")
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", 0.99).alias("p")).collect()}
    assert {r.g: r.p for r in group_percentile(df, "g", "v", 0.99, "p").collect()} == want


def test_numbers_in_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(20)) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "id int, v int").repartition(6), [F.col("v").desc(), F.col("id")], lambda df: df.cache(), "nth").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.nth)] == [i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))] and sorted(r.nth for r in got) == list(range(1, 501))
