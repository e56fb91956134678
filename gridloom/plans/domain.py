"""The domain's own files from end to end: CSV in, layers on landed Parquet, the export catalogue and a summary out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.exprs import round_away
from gridloom.plans import q_checks, q_kpi
from gridloom.plans.decisions import Decisions
from gridloom.plans.registry import catalogue
from gridloom.sources import grid_csv

# Exported name, the query or layer it holds, and its kind of file.
EXPORTS: dict[str, tuple[str, str]] = {
    "mart_node_hour_operational_state": ("node_state", "parquet"),
    "mart_zone_day_operational": ("zone_day", "csv"),
    "mart_zone_month_operational": ("zone_month", "csv"),
    "vw_zone_operational_risk": ("zone_risk", "csv"),
    "vw_assets_exposure": ("asset_exposure", "csv"),
    "vw_flexibility_gap": ("flex_gap", "csv"),
    "vw_investment_candidates": ("candidates", "csv"),
    "validation_checks": ("dq_pk_fk_domain", "csv"),
    "kpi_top_zonas_riesgo_operativo": ("kpi_top_zone_risk", "csv"),
    "kpi_top_subestaciones_congestion_acumulada": ("kpi_top_station_congestion", "csv"),
    "kpi_top_alimentadores_exposicion": ("kpi_top_feeder_exposure", "csv"),
    "kpi_zonas_mayor_ens": ("kpi_zone_ens", "csv"),
    "kpi_zonas_peor_ratio_flex_estres": ("kpi_worst_flex_ratio", "csv"),
    "kpi_zonas_potencial_capex_diferible": ("kpi_deferrable_capex", "csv"),
    "kpi_activos_mas_expuestos": ("kpi_exposed_assets", "csv"),
    "kpi_zonas_afectadas_ev_industrial": ("kpi_new_demand", "csv"),
}
#: Columns of the filtered priority table.
PRIORITIES = ("zone_id", "priority", "tier", "urgency_tier", "driver", "intervention", "sequence", "decision", "capex_total", "risk_cost")


def open_csv(spark: SparkSession, folder: str, landed: str) -> Decisions:
    """Land the fifteen CSV files of ``folder`` as Parquet in ``landed`` and give the layers over them."""
    grid_csv.land(spark, folder, landed)
    return open_landed(spark, landed)


def open_landed(spark: SparkSession, landed: str) -> Decisions:
    return Decisions(spark, landed, lambda role: grid_csv.frame(spark, landed, role))


def export(m: Decisions, folder: str) -> list[str]:
    """Write every object of the catalogue; gives the paths."""
    m.keep("node_state", "zone_day", "zone_month", "asset_exposure", "zone_risk", "flex_gap", "candidates")
    known, paths = catalogue(), []
    for name, (source, kind) in EXPORTS.items():
        df = known[source].plan(m) if source in known else getattr(m, source)
        paths += grid_csv.export({name: lambda df=df: df}, folder, kind)
    return paths


def summary(m: Decisions) -> str:
    """Counts and the data checks' outcome as JSON: one row of figures and one of checks come to the driver."""
    one = m.frame("demand").agg(F.count(F.lit(1)).alias("demand_rows"), F.countDistinct("zone_id").alias("zones"), F.countDistinct("feeder_id").alias("feeders")).first()
    failed = [(r.check_name, r.severity, r.observed) for r in q_kpi.checks(m).where("passed = 0").orderBy("severity", "check_name").collect()]  # one row a check
    status = "FAIL" if any(s == "alta" for _, s, _ in failed) else "WARN" if failed else "PASS"
    return json.dumps({**one.asDict(), "status": status, "failed": failed}, ensure_ascii=False)


def summary_markdown(text: str) -> str:
    """The JSON summary as a short list."""
    found = json.loads(text)
    return "\n".join([f"# Validation: {found['status']}", *(f"- {k}: {v}" for k, v in found.items() if k not in ("status", "failed")), *(f"- {severity}: {name} ({observed})" for name, severity, observed in found["failed"])]) + "\n"


def export_priorities(zones: DataFrame, path: str) -> None:
    """The filtered zones (see ``q_board.filtered``) by falling priority, as one CSV file with quotes where needed."""
    ordered = zones.select(*PRIORITIES).orderBy(round_away("priority", 6).desc(), "zone_id")
    grid_csv.write(ordered, path, single=True)


def landed_issues(m: Decisions) -> DataFrame:
    """Findings of the profile on the domain's own tables."""
    return q_checks.issues(m)
