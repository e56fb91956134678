"""The forecasts of the marts' own series, against a plain walk forward."""

import datetime as dt
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.plans import registry
from gridloom.plans.decisions import Decisions

START = dt.datetime(2024, 1, 1)


def walk(values, period, window, horizon):
    """Each held-out value and the five predictions of it."""
    for i in range(len(values) - horizon, len(values)):
        past, recent = values[:i], values[max(0, i - 180) : i]
        mx, my = (len(recent) - 1) / 2, sum(recent) / len(recent)
        slope = sum((k - mx) * (y - my) for k, y in enumerate(recent)) / sum((k - mx) ** 2 for k in range(len(recent)))
        level = past[0]
        for y in past[1:]:
            level = 0.35 * y + 0.65 * level
        yield values[i], past[-1], past[-period], sum(past[-window:]) / window, my + slope * (len(recent) - mx), level


def close(got, want):
    assert len(got) == len(want)
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))


@pytest.fixture(scope="module")
def marts(spark):
    rng = random.Random(5)
    nodes = [(f"z{i % 2}", f"s{i}", START + dt.timedelta(hours=h), rng.random() * 9, rng.random(), (h + i) % 24 == 18) for i in range(3) for h in range(212 * 24)]
    zones = {"zones": spark.createDataFrame([("z0", "urbana"), ("z1", "rural")], "zone_id string, zone_type string")}
    m = Decisions(spark, "", zones.__getitem__)
    m.__dict__["node_state"] = spark.createDataFrame(nodes, "zone_id string, station_id string, ts timestamp, demand_mw double, load_ratio double, peak_flag boolean").withColumn("day", F.to_date("ts")).cache()
    days = m.node_state.groupBy("zone_id", "day").agg(F.sum("demand_mw").alias("demand_mwh"))
    m.__dict__["zone_day"] = days.withColumns({"ev_mwh": F.col("demand_mwh") / 3 + F.dayofmonth("day"), "industry_mwh": F.col("demand_mwh") / F.dayofmonth("day")}).cache()
    return m


def test_daily_tasks(marts):
    zones, nodes = marts.zone_day.collect(), marts.node_state.collect()
    series = {}
    for r in sorted(zones, key=lambda r: r.day):
        for task, value in (("demanda_zona", r.demand_mwh), ("demanda_ev_zona", r.ev_mwh), ("demanda_industrial_zona", r.industry_mwh)):
            series.setdefault((task, r.zone_id), {})[r.day] = value
    loads = {}
    for r in nodes:
        loads.setdefault((r.zone_id, r.day), []).append(r.load_ratio)
        mine = series.setdefault(("demanda_subestacion", r.station_id), {})
        mine[r.day] = mine.get(r.day, 0) + r.demand_mw
    for (zone, day), v in loads.items():
        series.setdefault(("carga_relativa_zona", zone), {})[day] = sum(v) / len(v)
    got = {}
    for r in marts.day_forecast.orderBy("day").collect():
        got.setdefault((r.task, r.entity), []).append(tuple(r)[3:])
    assert got.keys() == series.keys()
    for key, by_day in series.items():
        close(got[key], list(walk([by_day[d] for d in sorted(by_day)], 7, 7, 90)))
    assert {(r.task, r.n) for r in marts.task_benchmark.collect()} == {(t, 90 * (3 if t == "demanda_subestacion" else 2)) for t, _ in series}
    best = min((r.mae, r.model) for r in marts.task_benchmark.collect() if r.task == "demanda_zona")
    types = {r.zone_type: r for r in marts.zone_type_errors.collect()}
    assert types.keys() == {"urbana", "rural"} and math.isclose(sum(r.mae for r in types.values()) / 2, best[0])


def test_hourly_task_and_its_peak(marts):
    series, peak = {}, set()
    for r in sorted(marts.node_state.collect(), key=lambda r: r.ts):
        mine = series.setdefault(r.zone_id, {})
        mine[r.ts] = mine.get(r.ts, 0) + r.demand_mw
        if r.peak_flag:
            peak.add((r.zone_id, r.ts))
    rows = marts.hour_forecast.orderBy("ts").collect()
    for zone, by_hour in series.items():
        close([tuple(r)[2:8] for r in rows if r.zone_id == zone], list(walk(list(by_hour.values()), 24, 24, 504)))
    assert all(r.peak == ((r.zone_id, r.ts) in peak) for r in rows)
    naive = next(r for r in marts.hour_peak_errors.collect() if r.model == "naive")
    at_peak = [abs(r.naive - r.actual) for r in rows if r.peak]
    assert math.isclose(naive.mae_peak, sum(at_peak) / len(at_peak)) and math.isclose(naive.mae_all, sum(abs(r.naive - r.actual) for r in rows) / len(rows))


@pytest.fixture(scope="module")
def long_folder(tmp_path_factory):
    """The small tables with events of 214 days, as the daily tasks need 210."""
    duckdb = pytest.importorskip("duckdb")
    folder, con = tmp_path_factory.mktemp("long"), duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if p.stem != "events":
            (folder / p.name).symlink_to(p)
    kinds = "['signup', 'click', 'view', 'error', 'purchase']"
    con.execute(f"""COPY (
        SELECT CAST(h * 4 + u AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * CAST(h AS INTEGER) AS ts, CAST(u AS BIGINT) AS user_id, {kinds}[CAST((h * 7 + u * 3 + h // 24) % 5 AS INTEGER) + 1] AS event_type,
               CAST((h * 7919 + u * 104729) % 1009 AS DOUBLE) / 10 AS value FROM range(214 * 24) a(h), range(4) b(u)) TO '{folder}/events.parquet'""")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return str(folder), con


@pytest.mark.parametrize("name", ["fc_tasks_daily", "fc_tasks_benchmark", "fc_tasks_winner", "fc_error_zone_type", "fc_hourly", "fc_hourly_peak"])
def test_query_equals_its_sql(spark, long_folder, name):
    folder, con = long_folder
    got = registry.queries()[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
