"""SQL text over layers, comparisons of written tables, correlation matrices, digests of files, the gates' failing cases."""

import hashlib
import itertools
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import diff
from gridloom.plans import layers, q_checks, q_layers
from gridloom.plans.decisions import Decisions
from gridloom.sources import manifest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def m(spark):
    m = Decisions(spark, FOLDER)
    m.keep("node_state")
    yield m
    m.release()


def test_three_texts_of_a_user(spark, m):
    before = {t.name for t in spark.catalog.listTables()}
    one = layers.sql(m, "SELECT zone_id, max(demand_mw) AS top FROM {demand} WHERE hour_of_day = :hour GROUP BY zone_id", hour=18)
    want = m.frame("demand").where("hour_of_day = 18").groupBy("zone_id").agg(F.max("demand_mw").alias("top"))
    assert sorted(one.collect()) == sorted(want.collect()) and one.count() > 0
    mine = spark.createDataFrame([(1, "mine"), (2, "mine")], "zone_id long, label string")
    two = layers.sql(m, "SELECT d.zone_id, label, count(*) AS n FROM {zone_day} d JOIN {notes} USING (zone_id) GROUP BY d.zone_id, label", {"notes": mine})
    assert {r.zone_id for r in two.collect()} <= {1, 2} and two.columns == ["zone_id", "label", "n"]
    done = layers.run(m, {"a": "SELECT feeder_id, capacity_mw FROM {feeders} WHERE capacity_mw > :least", "b": "SELECT count(*) AS n FROM {a}"}, least=60)
    assert list(done) == ["a", "b"] and done["b"].first().n == m.frame("feeders").where("capacity_mw > 60").count()
    assert {t.name for t in spark.catalog.listTables()} == before
    with pytest.raises(KeyError):
        layers.sql(m, "SELECT * FROM {no_such_layer}")


def test_all_layers_answer_as_views(spark, m):
    names = layers.publish(m, ("zone_hour", "node_state", "zone_day", "zone_month", "zone_risk", "flex_gap"), "v_")
    names = layers.publish(m, ("zone_hour", "node_state", "zone_day", "zone_month", "zone_risk", "flex_gap"), "v_")  # again: replaced
    assert [spark.sql(f"SELECT * FROM {n}").columns == layers.layer(m, n[2:]).columns for n in names] == [True] * 6
    for n in names:
        spark.catalog.dropTempView(n)


def test_board_adds_up(m):
    """Months and types of assets add up to what all of them give; a scenario is its factors."""
    every = q_layers.board(m).first()
    months = [r[0] for r in m.node_state.select(F.date_format("day", "yyyy-MM")).distinct().collect()]
    assert sum(q_layers.board(m, x, x).first().hours for x in months) == every.hours == m.node_state.count()
    kinds = [r[0] for r in m.month_measures.where("whole = 0").select("asset_type").distinct().collect()]
    assert sum(q_layers.board(m, asset_type=k).first().hours for k in kinds if k) <= every.hours
    late = q_layers.board(m, scenario="retraso_capex").first()
    assert late.ens_mwh == pytest.approx(every.ens_mwh * 1.2) and late.customers == every.customers
    assert q_layers.board(m, "1990-01", "1990-02").first().n_zones == 0


def test_differences_of_written_tables(spark):
    kinds = "k int, j string, x double, y string"
    a = spark.createDataFrame([(1, "a", 1.0, "p"), (2, "a", None, "p"), (3, None, 2.0, None), (4, "b", 1.0, "q"), (5, "c", 1.0, "r"), (5, "c", 2.0, "r"), (7, "d", None, "s")], kinds)
    b = spark.createDataFrame([(1, "a", 1.0, "p"), (2, "a", None, "p"), (3, None, 2.0, None), (4, "b", 1.5, "q"), (5, "c", 2.0, "r"), (5, "c", 1.0, "r"), (6, "z", 1.0, "t"), (7, "d", 0.0, "s")], kinds)
    got = {(r.k, r.j): r.status for r in diff.compared(a, b, ["k", "j"]).collect()}
    assert got == {(1, "a"): "same", (2, "a"): "same", (3, None): "same", (4, "b"): "changed", (5, "c"): "same", (6, "z"): "right_only", (7, "d"): "changed"}
    assert {r.status for r in diff.compared(a, a.limit(0), ["k", "j"]).collect()} == {"left_only"}
    assert diff.compared(a, b, ["k", "j"], ["y"]).where("status = 'changed'").count() == 0


def test_matrix_equals_that_of_pandas(spark):
    rng = random.Random(1)
    rows = [tuple(None if rng.random() < 0.2 else rng.gauss(0, 1) for _ in range(4)) + (1.0,) for _ in range(300)]
    names = ["a", "b", "c", "d", "same"]
    got = {(r.a, r.b): r.r for r in diff.correlations(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4), names).collect()}
    want = pd.DataFrame(rows, columns=names).astype(float).corr()
    for p, q in itertools.product(names, names):
        assert (got[p, q] is None or np.isnan(got[p, q])) if np.isnan(want.loc[p, q]) else abs(got[p, q] - want.loc[p, q]) < 1e-9


def test_manifest_of_an_export(spark, tmp_path):
    out = f"{tmp_path}/export"
    spark.range(1000).selectExpr("id", "id % 7 as k").write.partitionBy("k").option("header", True).csv(out)
    files = {str(p.relative_to(out)): p for p in Path(out).rglob("*.csv")}
    got = {r.file: (r.n_bytes, r.sha256) for r in manifest.manifest(spark, out, "*.csv").collect()}
    assert got == {k: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for k, p in files.items()} and len(got) >= 7
    one = next(iter(files.values()))
    raw = bytearray(one.read_bytes())
    raw[-2] ^= 1
    one.write_bytes(raw)
    one.with_name(f".{one.name}.crc").unlink()  # the local file system's own check
    before, after = spark.createDataFrame([(k, *v) for k, v in got.items()], "file string, n_bytes long, sha256 string"), manifest.manifest(spark, out, "*.csv")
    assert [(r.file, r.status) for r in diff.compared(before, after, ["file"]).where("status <> 'same'").collect()] == [(str(one.relative_to(out)), "changed")]


GOOD = {
    "scoring": ([(1, 80.0), (2, 60.0)], "zone_id int, priority double"), "ranking": ([(1, 1), (2, 2)], "zone_id int, rank int"), "impacts": ([("s", 1.0), ("s", 2.0)], "scenario string, cost double"), "summary": ([("s", 3.0)], "scenario string, cost double"),
    "detected": ([("t",), ("t",)], "anomaly_type string"), "told": ([("t", 2)], "anomaly_type string, n long"), "benchmark": ([(t,) for t in q_checks.TASK_NAMES], "task string"), "sensitivity": ([(1, 1), (2, 2)], "zone_id int, rank int"),
}
BAD = {
    "scoring_filled": ("scoring", []), "scenarios_filled": ("summary", []), "anomalies_filled": ("detected", []), "benchmark_filled": ("benchmark", []), "sensitivity_filled": ("sensitivity", []),
    "ranking_matches_scoring_top": ("ranking", [(2, 1), (1, 2)]), "scenario_cost_consistency": ("summary", [("s", 3.1)]), "anomaly_summary_consistency": ("told", [("t", 3)]), "score_stability_rank_shift": ("sensitivity", [(1, 5), (2, 2)]),
    "forecast_required_tasks_covered": ("benchmark", [(t,) for t in q_checks.TASK_NAMES[1:]]),
}


@pytest.mark.parametrize("gate", [None, *BAD])
def test_every_gate_can_fail(spark, gate):
    frames = {k: spark.createDataFrame(BAD[gate][1] if gate and BAD[gate][0] == k else rows, kinds) for k, (rows, kinds) in GOOD.items()}
    got = {r.gate: r.passed for r in q_checks.output_gates(**frames).collect()}
    assert set(got) == set(BAD)
    if gate is None:
        assert set(got.values()) == {1}
    else:
        assert got[gate] == 0


def test_bucketed_table_needs_no_exchange(spark, m, tmp_path):
    """Windows and aggregates by feeder over the saved layer read it as it lies; saving again replaces it."""
    from pyspark.sql import Window

    own = Decisions(spark, FOLDER)
    own.__dict__["node_state"] = m.node_state
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            saved = own.save_table("node_state", "gridloom_test_nodes", buckets=4)
        assert saved.count() == m.node_state.count()
        w = Window.partitionBy("feeder_id").orderBy("ts").rowsBetween(-719, 0)
        rolled = saved.select("feeder_id", "ts", F.sum("demand_mw").over(w).alias("s"))
        loads = saved.groupBy("feeder_id").agg(F.avg("load_ratio").alias("mean"))
        for df in (rolled, loads, saved.join(loads, "feeder_id")):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString(), df.columns
        plain = m.node_state.select("feeder_id", "ts", F.sum("demand_mw").over(w).alias("s"))
        assert rolled.exceptAll(plain.where("false")).count() == plain.count() and "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert own.node_state is saved and own.asset_exposure.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS gridloom_test_nodes")


def test_queries_by_name_share_their_layers(spark, tmp_path):
    import shutil

    from gridloom.plans import query, registry

    folder = f"{tmp_path}/tables"
    shutil.copytree(FOLDER, folder)
    query.clear()
    q = registry.catalogue()
    first = q["mart_zone_day"].run(spark, folder)
    own = query.shared(spark, folder)
    stored = list(own._paths)
    assert q["mart_zone_month"].run(spark, folder).count() > 0 and first.count() > 0
    assert query.shared(spark, folder) is own and own._paths[: len(stored)] == stored
    spark.range(3).write.parquet(f"{folder}/more.parquet")  # the input is another one now
    assert query.shared(spark, folder) is not own
    query.clear()
    assert not own._paths and not own._kept


def test_usual_demand_is_added_up_in_one_order(spark, tmp_path):
    """Three hours of one hour of the day, whose sum depends on its order in the last bit, in all six orders."""
    for table in Path(FOLDER).iterdir():
        if table.stem != "events":
            (tmp_path / table.name).symlink_to(table)
    rng, hours = random.Random(3), []
    for values in [[rng.randrange(1, 20_000) / 100 for _ in range(3)] for _ in range(40)]:
        hours += list(itertools.permutations(values))
    rows = [(10**6 + 3 * u + i, f"2024-01-{day} 06:10:00", 1000 + u, "view", v, None) for u, three in enumerate(hours) for i, (day, v) in enumerate(zip(("06", "07", "13"), three, strict=True))]
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    new = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.unionByName(new).orderBy(F.desc("ts")).write.parquet(str(tmp_path / "events.parquet"))
    m = Decisions(spark, str(tmp_path))
    got = {(r.feeder_id, r.day.day): r.vs_usual for r in m.node_features.where("feeder_id >= 1000").select("feeder_id", "day", "vs_usual").collect()}
    m.release()
    want = {(1000 + u, day): (v - (c + b + a) / 3) / ((c + b + a) / 3) for u, (a, b, c) in enumerate(hours) for day, v in ((6, a), (7, b), (13, c))}
    assert got == want
