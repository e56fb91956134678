"""The domain's own CSV files, from reading to export."""

import csv
import datetime as dt
import inspect
import json
import random
from pathlib import Path

import pytest

from gridloom.plans import domain, q_board, q_checks, q_decisions, q_kpi, q_marts, registry
from gridloom.plans.decisions import Decisions
from gridloom.sources import grid_csv, stages

START = dt.datetime(2024, 3, 1)
KINDS = ("nuevo_alimentador", "almacenamiento_red", "automatizacion_avanzada", "gestion_demanda")


def value(rng, name, kind):
    if kind == "double":
        return round(rng.random(), 4) if name in ("facilidad_implementacion", "impacto_resiliencia", "reduccion_riesgo_esperada", "probabilidad_fallo_proxy", "criticidad", "disponibilidad_media") else round(rng.random() * 50 + 1, 4)
    if kind in ("int", "bigint"):
        return rng.randrange(1, 40)
    if kind == "boolean":
        return rng.random() < 0.3
    if kind == "date":
        return START.date()
    if kind == "timestamp_ntz":
        return START
    return f"{name[:3]}, {rng.randrange(3)}"


def rows(rng, table, count, **fixed):
    columns = [(c, k) for t, c, k in grid_csv.describe([table])]
    for i in range(count):
        yield {c: fixed[c](i) if c in fixed else value(rng, c, k) for c, k in columns}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, out = random.Random(3), tmp_path_factory.mktemp("csv")
    zone, station, feeder = lambda i: f"Z{i % 3}", lambda i: f"S{i % 6}", lambda i: f"F{i % 12}"
    of_hour = lambda n: (lambda i: START + dt.timedelta(hours=i // n))
    hours = 24 * 3
    tables = {
        "zonas_red": rows(rng, "zonas_red", 3, zona_id=zone), "subestaciones": rows(rng, "subestaciones", 6, subestacion_id=station, zona_id=zone), "alimentadores": rows(rng, "alimentadores", 12, alimentador_id=feeder, subestacion_id=station),
        "demanda_horaria": rows(rng, "demanda_horaria", hours * 12, timestamp=of_hour(12), zona_id=zone, subestacion_id=station, alimentador_id=feeder, hora=lambda i: i // 12 % 24, mes=lambda i: 3, tipo_dia=lambda i: "laborable", hora_punta_flag=lambda i: i // 12 % 24 == 20),
        "generacion_distribuida": rows(rng, "generacion_distribuida", hours * 3, timestamp=of_hour(3), zona_id=zone), "demanda_ev": rows(rng, "demanda_ev", hours * 3, timestamp=of_hour(3), zona_id=zone),
        "demanda_electrificacion_industrial": rows(rng, "demanda_electrificacion_industrial", hours * 3, timestamp=of_hour(3), zona_id=zone),
        "eventos_congestion": rows(rng, "eventos_congestion", 9, evento_id=lambda i: f"E{i}", timestamp_inicio=of_hour(1), timestamp_fin=lambda i: START + dt.timedelta(hours=i + 2), zona_id=zone, subestacion_id=station, alimentador_id=feeder, severidad=lambda i: ("critica", "baja")[i % 2]),
        "interrupciones_servicio": rows(rng, "interrupciones_servicio", 5, interrupcion_id=lambda i: f"I{i}", timestamp_inicio=of_hour(1), timestamp_fin=lambda i: START + dt.timedelta(hours=i + 1), zona_id=zone, subestacion_id=station),
        "activos_red": rows(rng, "activos_red", 20, activo_id=lambda i: f"A{i}", subestacion_id=station, alimentador_id=lambda i: None if i % 5 == 0 else feeder(i)),
        "recursos_flexibilidad": rows(rng, "recursos_flexibilidad", 4, zona_id=zone), "almacenamiento_distribuido": rows(rng, "almacenamiento_distribuido", 4, zona_id=zone), "intervenciones_operativas": rows(rng, "intervenciones_operativas", 4, zona_id=zone),
        "inversiones_posibles": rows(rng, "inversiones_posibles", 8, inversion_id=lambda i: f"V{i}", zona_id=zone, tipo_inversion=lambda i: KINDS[i % 4]), "escenario_macro": rows(rng, "escenario_macro", 3, fecha=lambda i: (START + dt.timedelta(days=i)).date(), escenario=lambda i: "base"),
    }
    assert set(tables) == set(grid_csv.FILES)
    for name, found in tables.items():
        found = list(found)
        with open(out / f"{name}.csv", "w", newline="") as f:
            w = csv.DictWriter(f, found[0])
            w.writeheader()
            w.writerows({k: str(v).lower() if isinstance(v, bool) else v for k, v in r.items()} for r in found)
    return str(out)


@pytest.fixture(scope="module")
def marts(spark, folder, tmp_path_factory):
    return domain.open_csv(spark, folder, str(tmp_path_factory.mktemp("landed")))


def test_csv_is_read_by_its_schema(spark, folder, tmp_path):
    df = grid_csv.read_csv(spark, folder, "demanda_horaria")
    assert dict(df.dtypes) == {c: k for _, c, k in grid_csv.describe(["demanda_horaria"])} and df.count() == 864
    (tmp_path / "zonas_red.csv").write_text("zona_id,other\n1,2\n")
    with pytest.raises(Exception):
        grid_csv.read_csv(spark, str(tmp_path), "zonas_red").collect()
    grid_csv.register(spark, folder, ["subestaciones"])
    assert spark.sql("SELECT count(*) FROM subestaciones").first()[0] == 6


def test_layers_over_landed_files(marts, folder):
    with open(f"{folder}/demanda_horaria.csv") as f:
        demand = sum(float(r["demanda_mw"]) for r in csv.DictReader(f))
    days = marts.zone_day.collect()
    assert len(days) == 9 and abs(sum(r.demand_mwh for r in days) - demand) < 1e-6
    assert marts.candidates.count() == 8 and {r.family for r in marts.candidates.collect()} == {"refuerzo_fisico", "storage_distribuido", "operacion_avanzada", "flexibilidad_operativa"}
    assert marts.asset_exposure.where("feeder_id IS NULL AND exposure_score IS NULL AND adjusted_p = 1.0").count() == 4


def test_export_and_summary(spark, marts, tmp_path):
    paths = domain.export(marts, str(tmp_path))
    assert len(paths) == 16 and all(Path(p).exists() for p in paths)
    assert spark.read.parquet(paths[0]).count() == 864
    found = json.loads(domain.summary(marts))
    assert (found["demand_rows"], found["zones"], found["feeders"]) == (864, 3, 12) and found["status"] in ("PASS", "WARN", "FAIL")
    assert domain.summary_markdown(json.dumps(found)).startswith(f"# Validation: {found['status']}")
    assert {r.priority for r in domain.landed_issues(marts).collect()} >= {"P3"}


def test_filtered_table_keeps_its_order(spark, tmp_path):
    m = Decisions(spark, "/root/testdata/sf0.001")
    domain.export_priorities(q_board.filtered(m, region="ASIA"), f"{tmp_path}/priorities.csv")
    (part,) = Path(f"{tmp_path}/priorities.csv").glob("*.csv")
    with open(part) as f:
        got = list(csv.DictReader(f))
    assert tuple(got[0]) == domain.PRIORITIES and [float(r["priority"]) for r in got] == sorted((float(r["priority"]) for r in got), reverse=True)
    assert q_board.filtered(m, station=5).count() == 1 and q_board.filtered(m, tier="none").count() == 0
    m.release()


#: Queries that read the general tables themselves, so that the domain's files have nothing for them.
GENERAL = {name for name, q in registry.catalogue().items() if "m.table(" in inspect.getsource(q.plan) or q.name in ("catalogue_columns",)}


@pytest.mark.parametrize("module", [q_decisions, q_board, q_kpi, q_checks, q_marts])
def test_every_query_runs_on_the_domains_files(spark, marts, module):
    failed = {}
    for q in module.QUERIES:
        if q.name not in GENERAL:
            try:
                q.run(spark, marts.sf_dir, marts).collect()
            except Exception as e:
                failed[q.name] = str(e)[:300]
    assert not failed


def scored(marts, **given):
    """Scores of the same layers under other inputs of the forecast and anomaly stages."""
    m = Decisions(marts.spark, marts.sf_dir, marts._frame)
    m._kept.update(marts._kept)
    m.__dict__.update({k: v for k, v in marts.__dict__.items() if k in marts._kept and k not in ("score_base", "scores", "options", "ranking", "predictability", "zone_intensity")})
    return {r.zone_id: r for r in m.use(**given).score_base.collect()}, m


def test_scores_with_and_without_earlier_stages(spark, marts, tmp_path):
    own = {r.zone_id: r for r in marts.score_base.collect()}
    assert set(own) == {"Z0", "Z1", "Z2"} and all(r.decision == "forecast_no_disponible" and r.mae == 0 for r in own.values())  # three days are no series
    assert any(r.mean_score > 0 for r in own.values())
    bare, m = scored(marts, forecast=None, anomaly=f"{tmp_path}/not_there.csv")
    assert all((r.mae, r.new_ratio, r.decision, r.mean_score, r.critical, r.congestion_share) == (0, 0, "forecast_no_disponible", 0, 0, 0) for r in bare.values())
    assert m.ranking.count() == 3 and m.scenario_summary.count() == len(scenarios_of(m))
    m.release()
    Path(f"{tmp_path}/forecast.csv").write_text("Zone_ID,mae,decision,more\nZ0,2.5,forecast_suficiente_para_diferir_capex,x\nZ9,1,y,z\n")
    spark.createDataFrame([("Z1", 4, 3.5)], "zone_id string, n int, mean_score double").write.parquet(f"{tmp_path}/anomaly.parquet")
    some, m = scored(marts, forecast=f"{tmp_path}/forecast.csv", anomaly=f"{tmp_path}/anomaly.parquet")
    assert {z: (r.mae, r.new_ratio, r.decision, r.mean_score) for z, r in some.items()} == {"Z0": (2.5, 0, "forecast_suficiente_para_diferir_capex", 0), "Z1": (0, 0, "forecast_no_disponible", 3.5), "Z2": (0, 0, "forecast_no_disponible", 0)}
    m.release()


def scenarios_of(m):
    return m.scenarios.select("scenario").distinct().collect()


def test_an_input_without_rows_or_columns(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType

    got = stages.resolve(spark, "forecast", f"{tmp_path}/none", StringType())
    assert got.count() == 0 and [f.simpleString() for f in got.schema] == ["zone_id:string", "mae:double", "new_ratio:double", "decision:string"]
    (tmp_path / "empty").mkdir()
    assert stages.resolve(spark, "anomaly", f"{tmp_path}/empty", LongType()).schema["zone_id"].dataType == LongType()
    assert stages.resolve(spark, "scoring", spark.createDataFrame([(1, "x")], "ZONE_ID int, tier string"), LongType()).collect() == [(1, None, "x", None)]


def test_filtered_table_of_the_domains_files(marts, tmp_path):
    domain.export_priorities(q_board.filtered(marts), f"{tmp_path}/all.csv")
    (part,) = Path(f"{tmp_path}/all.csv").glob("*.csv")
    with open(part) as f:
        got = list(csv.DictReader(f))
    assert {r["zone_id"] for r in got} == {"Z0", "Z1", "Z2"} and [float(r["priority"]) for r in got] == sorted((float(r["priority"]) for r in got), reverse=True)
    assert q_board.filtered(marts, station="S1").count() == 1


def test_no_query_repeats_scans(spark):
    """Plans read stored layers: none has more than 40 leaves."""
    shared = Decisions(spark, "/root/testdata/sf0.001")
    for name in ("mart_zone_day", "investment_candidates", "dq_pk_fk_domain", "score_priority_rules", "scenario_top15", "what_if", "chart_bars", "dq_output_gates", "dq_readiness"):
        df = registry.catalogue()[name].run(spark, shared.sf_dir, shared)
        assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 40, name
    shared.release()
