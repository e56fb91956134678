"""Multi-criteria scores, intervention options, priority rules, sensitivity and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import clamp, largest_name, last_wins, risk_tier, urgency_tier, weighted
from gridloom.operators.scales import min_max, min_max_within

# Weights of the seven scores' inputs ("-x": 100 minus the scaled figure), and of the scores in urgency.
SCORES = {
    "congestion_risk_score": {"congested_hours": 0.40, "peak_mw": 0.30, "congested_total": 0.20, "congestion_share": 0.10},
    "resilience_risk_score": {"ens_mean": 0.38, "unserved_mwh": 0.22, "-resilience": 0.20, "mean_score": 0.20},
    "service_impact_score": {"customers_mean": 0.40, "ens_mean": 0.25, "critical": 0.20, "outage_share": 0.15},
    "flexibility_gap_score": {"flex_gap_mwh": 0.42, "-flex_ratio": 0.28, "gap_mw": 0.20, "economic_gap": 0.10},
    "asset_exposure_score": {"exposure": 0.50, "adjusted_p": 0.30, "exposed_ens": 0.20},
    "electrification_pressure_score": {"new_ratio": 0.40, "growth": 0.30, "new_demand_mwh": 0.20, "mae": 0.10},
    "economic_priority_score": {"risk_cost": 0.45, "capex_intensity": 0.30, "capex_total": 0.15, "capex_mean": 0.10},
}
URGENCY = {"congestion_risk_score": 0.22, "resilience_risk_score": 0.16, "service_impact_score": 0.14, "flexibility_gap_score": 0.14, "asset_exposure_score": 0.12, "electrification_pressure_score": 0.10, "economic_priority_score": 0.12}
# Options with the weights of their impact, shares of cost and time, and robustness.
OPTIONS = {
    "refuerzo_red": ({"congestion_risk_score": 0.55, "electrification_pressure_score": 0.25, "service_impact_score": 0.20}, 1.0, 1.0, 0.90),
    "flexibilidad": ({"flexibility_gap_score": 0.45, "congestion_risk_score": 0.25, "economic_priority_score": 0.30}, 0.35, 0.55, 0.68),
    "almacenamiento": ({"flexibility_gap_score": 0.40, "service_impact_score": 0.35, "electrification_pressure_score": 0.25}, 0.55, 0.70, 0.76),
    "intervencion_operativa": ({"congestion_risk_score": 0.35, "asset_exposure_score": 0.30, "resilience_risk_score": 0.35}, 0.18, 0.35, 0.60),
}
# The intervention of each option, and when each intervention comes.
INTERVENTION = {"refuerzo_red": "reforzar_red_local", "flexibilidad": "activar_flexibilidad", "almacenamiento": "desplegar_almacenamiento", "intervencion_operativa": "optimizar_operacion"}
SEQUENCE = {
    "intervencion_inmediata_prioritaria": "0-6m",
    "sustituir_activos": "0-12m",
    "reforzar_red_local": "6-24m",
    "desplegar_almacenamiento": "3-12m",
    "activar_flexibilidad": "0-6m",
    "optimizar_operacion": "0-3m",
    "monitorizar": "revision_trimestral",
}
# Factors of load, congestion, ENS, curtailment, flexibility gap, risk cost, CAPEX and priority of each scenario.
SCENARIOS = {
    "crecimiento_acelerado_ev": (1.12, 1.18, 1.10, 1.05, 1.16, 1.14, 1.10, 1.09),
    "electrificacion_industrial_intensiva": (1.10, 1.16, 1.12, 1.08, 1.18, 1.18, 1.15, 1.12),
    "mayor_penetracion_gd": (0.98, 1.07, 1.02, 1.25, 1.08, 1.06, 1.07, 1.05),
    "retraso_capex": (1.03, 1.20, 1.20, 1.12, 1.22, 1.26, 1.22, 1.18),
    "despliegue_adicional_flexibilidad": (0.99, 0.82, 0.88, 0.90, 0.70, 0.84, 0.92, 0.86),
    "despliegue_adicional_storage": (0.99, 0.86, 0.90, 0.75, 0.72, 0.86, 0.96, 0.88),
    "capex_mas_flexibilidad": (0.98, 0.76, 0.82, 0.80, 0.62, 0.78, 1.04, 0.80),
    "evento_degradacion_activos": (1.04, 1.24, 1.30, 1.10, 1.14, 1.28, 1.18, 1.20),
}


def lookup(table: dict[str, str], key: str) -> F.Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col(key)]


def seven_scores(base: DataFrame) -> DataFrame:
    """The seven scores of each zone, from figures scaled over all zones."""
    inputs = list(dict.fromkeys(n.lstrip("-") for parts in SCORES.values() for n in parts))
    out = min_max(base, inputs)
    part = lambda n: F.lit(100.0) - F.col(f"{n[1:]}_mm") if n[0] == "-" else F.col(f"{n}_mm")
    out = out.withColumns({score: weighted([(w, part(n)) for n, w in parts.items()]) for score, parts in SCORES.items()})
    return out.withColumn("urgency", weighted(URGENCY)).drop(*(f"{n}_mm" for n in inputs))


def options(scored: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Four options a zone, scored against each other within the zone."""
    rows = F.array(*(F.struct(F.lit(i).alias("nth"), F.lit(name).alias("option"), weighted(parts).alias("impact"), (F.lit(cost) * F.col("capex_total")).alias("cost"), (F.lit(time) * F.col("mean_horizon")).alias("time"), F.lit(robust).alias("robustness")) for i, (name, (parts, cost, time, robust)) in enumerate(OPTIONS.items())))
    long = scored.select(zone, "urgency", F.explode(rows).alias("o")).select(zone, "urgency", "o.*")
    long = long.withColumns({"cost_mm": min_max_within("cost", [zone]), "time_mm": min_max_within("time", [zone])})
    score = weighted([(0.40, "impact"), (0.20, F.lit(100.0) - F.col("cost_mm")), (0.15, F.lit(100.0) - F.col("time_mm")), (0.15, "urgency"), (0.10, F.lit(100.0) * F.col("robustness"))])
    return long.withColumn("option_score", score)


def best_option(opts: DataFrame, zone: str = "zone_id") -> DataFrame:
    top = F.max_by(F.struct("option", "option_score"), F.struct("option_score", -F.col("nth")))
    return opts.groupBy(zone).agg(top.alias("b")).select(zone, "b.option", "b.option_score")


def priorities(scored: DataFrame, best: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Priority, tiers, the recommended intervention with its overrides (the last that holds wins), sequence, driver and confidence."""
    out = scored.join(best, zone, "left").withColumn("priority", clamp(F.lit(0.74) * F.col("urgency") + F.lit(0.26) * F.col("option_score"), 0.0, 100.0))
    rules = [(F.col("asset_exposure_score") >= 75, "sustituir_activos"), (F.col("priority") >= 90, "intervencion_inmediata_prioritaria"), (F.col("priority") < 45, "monitorizar")]
    out = out.withColumn("intervention", last_wins(lookup(INTERVENTION, "option"), rules))
    middle = out.agg(F.median("mae").alias("median_mae"))
    return out.crossJoin(F.broadcast(middle)).withColumns({
        "tier": risk_tier("priority"), "urgency_tier": urgency_tier("priority"), "sequence": lookup(SEQUENCE, "intervention"), "driver": largest_name(list(SCORES)),
        "confidence": F.when(F.col("mae") <= F.col("median_mae"), "alta_confianza").otherwise("media_confianza_requiere_seguimiento"),
    })


def sensitivity(scored: DataFrame, factors: tuple[float, ...] = (0.9, 1.1), zone: str = "zone_id") -> DataFrame:
    """Each zone's rank with the first two weights scaled, the others as they are."""
    moved = list(URGENCY)[:2]
    long = scored.withColumn("factor", F.explode(F.array(*(F.lit(f) for f in factors))))
    alt = weighted([(1.0, F.lit(w) * F.col("factor") * F.col(s) if s in moved else F.lit(w) * F.col(s)) for s, w in URGENCY.items()])
    w = Window.partitionBy("factor").orderBy(F.desc("alternative"), zone)
    return long.withColumn("alternative", alt).withColumn("rank", F.row_number().over(w))


def scenarios(ranked: DataFrame, months: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Eight scenarios of every zone, ranked within each scenario."""
    names = ("load_f", "congestion_f", "ens_f", "curtailment_f", "flex_f", "risk_f", "capex_f", "priority_f")
    rows = F.array(*(F.struct(F.lit(s).alias("scenario"), *(F.lit(v).alias(n) for n, v in zip(names, values, strict=True))) for s, values in SCENARIOS.items()))
    x = ranked.join(months, zone, "left").fillna(0.0).withColumn("s", F.explode(rows)).select("*", "s.*").drop("s")
    x = x.withColumns({
        "load": F.col("peak_mw") * F.col("load_f"), "congestion": F.col("congested_hours") * F.col("congestion_f"), "ens": F.col("ens_mean") * F.col("ens_f"), "curtailment": F.col("curtailment_base") * F.col("curtailment_f"),
        "flex_gap": F.col("flex_gap_mwh") * F.col("flex_f"), "cost": F.col("risk_cost") * F.col("risk_f"),
        "investment": F.col("capex_total") * F.col("capex_f") + F.lit(0.20) * F.col("capex_intensity") * F.greatest("flex_f", F.lit(1.0)),
        "scenario_priority": clamp(F.col("priority") * F.col("priority_f"), 0.0, 100.0),
    })
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("scenario_priority"), zone)))


def what_if(scored: DataFrame, ev: float, industry: float, flex: float, storage: float) -> DataFrame:
    """A zone's priority under changed electrification (percent) and added flexibility and storage, and the action that follows."""
    gap = F.col("flexibility_gap_score") * F.lit(1 - 0.006 * flex - 0.0045 * storage)
    pressure = F.col("electrification_pressure_score") * F.lit(1 + 0.006 * ev + 0.004 * industry)
    out = scored.withColumn("adjusted_gap", gap).withColumn("simulated", clamp(F.lit(0.58) * F.col("priority") + F.lit(0.24) * pressure + F.lit(0.18) * gap, 0.0, 100.0))
    s, g = F.col("simulated"), F.col("adjusted_gap")
    action = F.when(s >= 85, "intervencion_inmediata_prioritaria").when((s >= 74) & (g >= 58), "reforzar_red_local").when((s >= 62) & (g >= 48), "desplegar_almacenamiento")
    return out.withColumn("action", action.when(s >= 52, "activar_flexibilidad").otherwise("optimizar_operacion"))
