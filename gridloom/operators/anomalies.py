"""Six anomaly detectors over feature tables, their union, and what follows each anomaly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import anomaly_severity, ratio
from gridloom.operators.quantiles import Once, group_percentile

COLUMNS = ("ts", "day", "zone_id", "station_id", "feeder_id", "anomaly_type", "observed", "threshold", "score", "explanation")
# What to do on each type.
ADVICE = {
    "demanda_inesperada": "monitorizar_intradia_y_activar_flex_rapida",
    "carga_relativa_anormal": "reconfigurar_red_y_preparar_alivio",
    "curtailment_anormal": "optimizar_despacho_GD_storage",
    "ens_atipica": "activar_plan_resiliencia_servicio",
    "deterioro_operativo_subestacion": "inspeccion_activos_y_mantenimiento_dirigido",
    "desviacion_vs_patron": "validar_medicion_y_ajustar_modelo_operativo",
}

# Explanations of each type; where there are two, of what is high (or at the peak hour) and of the rest.
WHY = {
    "demanda_inesperada": ("pico_no_esperado_posible_EV_o_industrial", "caida_anomala_posible_reconfiguracion_o_fallo_medicion"),
    "carga_relativa_anormal": ("saturacion_termica_o_desbalance_operativo",),
    "curtailment_anormal": ("exceso_GD_vs_capacidad_local_o_restriccion_operativa",),
    "ens_atipica": ("degradacion_servicio_o_evento_meteo_con_impacto",),
    "deterioro_operativo_subestacion": ("acumulacion_estres_y_posible_degradacion_activos",),
    "desviacion_vs_patron": ("desviacion_en_hora_punta_sensible", "desviacion_fuera_patron_estacional"),
}


def _shape(df: DataFrame, kind: str, observed: Column, threshold: Column, score: Column, explanation: Column) -> DataFrame:
    none = [F.lit(None).cast("long").alias(c) for c in ("station_id", "feeder_id") if c not in df.columns]
    ts = [] if "ts" in df.columns else [F.col("day").cast("timestamp_ntz").alias("ts")]
    wide = df.select("*", *none, *ts, F.lit(kind).alias("anomaly_type"), observed.alias("observed"), threshold.alias("threshold"), score.alias("score"), explanation.alias("explanation"))
    return wide.select(*COLUMNS)


def rolling(column: str, group: str, rows: int, least: int, order: str = "day") -> tuple[Column, Column]:
    """Mean and sample deviation of the last ``rows`` rows, null before ``least`` of them."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(1 - rows, 0)
    enough = F.count(column).over(w) >= least
    return F.when(enough, F.avg(column).over(w)), F.when(enough, F.stddev_samp(column).over(w))


def unexpected_demand(nodes: DataFrame, limit: float = 3.0) -> DataFrame:
    """Demand far from its 24-row mean by the feeder's own spread of such residuals."""
    rows = nodes.withColumn("residual", F.col("demand_mw") - F.col("mean_24"))
    rows = rows.withColumn("spread", F.stddev_samp("residual").over(Window.partitionBy("feeder_id")))
    rows = rows.withColumn("z", F.coalesce(ratio("residual", "spread"), F.lit(0.0))).where(F.abs("z") >= limit)
    high, rest = WHY["demanda_inesperada"]
    why = F.when(F.col("residual") > 0, high).otherwise(rest)
    return _shape(rows, "demanda_inesperada", F.col("demand_mw"), F.col("mean_24") + F.lit(limit) * F.col("spread"), F.abs("z"), why)


def abnormal_load(nodes: DataFrame, share: float = 0.99, limit: float = 1.15, once: Once | None = None) -> DataFrame:
    rows = group_percentile(nodes, "feeder_id", "load_ratio", share, "p", once).where((F.col("load_ratio") >= F.col("p")) | (F.col("load_ratio") >= limit))
    return _shape(rows, "carga_relativa_anormal", F.col("load_ratio"), F.greatest("p", F.lit(limit)), F.lit(2.5) + F.greatest(F.col("load_ratio") - 1.0, F.lit(0.0)) * 10.0, F.lit(WHY["carga_relativa_anormal"][0]))


def abnormal_curtailment(nodes: DataFrame, share: float = 0.99, limit: float = 0.18, once: Once | None = None) -> DataFrame:
    rows = nodes.withColumn("cut", F.coalesce("curtailment_ratio", F.lit(0.0)))
    rows = group_percentile(rows, "zone_id", "cut", share, "p", once).where((F.col("cut") >= F.col("p")) & (F.col("cut") >= limit))
    return _shape(rows, "curtailment_anormal", F.col("cut"), F.greatest("p", F.lit(limit)), F.lit(2.0) + F.col("cut") * 8.0, F.lit(WHY["curtailment_anormal"][0]))


def atypical_ens(days: DataFrame, spread: float = 2.5) -> DataFrame:
    mean, dev = rolling("ens_mwh", "zone_id", 30, 7)
    rows = days.select("day", "zone_id", "ens_mwh").withColumn("limit", mean + F.lit(spread) * F.coalesce(dev, F.lit(0.0)))
    rows = rows.where((F.col("ens_mwh") > F.col("limit")) & (F.col("ens_mwh") > 0))
    return _shape(rows, "ens_atipica", F.col("ens_mwh"), F.col("limit"), F.lit(2.0) + F.coalesce(ratio("ens_mwh", "limit"), F.lit(0.0)), F.lit(WHY["ens_atipica"][0]))


def station_trend(nodes: DataFrame, spread: float = 1.75) -> DataFrame:
    """Substations whose weekly share of stressed hours rises above its month."""
    stress = F.when((F.col("load_ratio") >= 0.95) | F.col("congested"), 1.0).otherwise(0.0)
    days = nodes.groupBy("day", "station_id", "zone_id").agg(F.avg(stress).alias("share"))
    week, _ = rolling("share", "station_id", 7, 5)
    month, dev = rolling("share", "station_id", 30, 10)
    rows = days.withColumns({"week": week, "month": month, "dev": F.coalesce(dev, F.lit(0.0))}).where(F.col("week") > F.col("month") + F.lit(spread) * F.col("dev"))
    return _shape(rows, "deterioro_operativo_subestacion", F.col("week"), F.col("month") + F.lit(spread) * F.col("dev"), F.lit(1.8) + F.greatest(F.col("week") - F.col("month"), F.lit(0.0)) * 10.0, F.lit(WHY["deterioro_operativo_subestacion"][0]))


def off_pattern(nodes: DataFrame, limit: float = 0.35) -> DataFrame:
    rows = nodes.withColumn("off", F.coalesce("vs_usual", F.lit(0.0))).where(F.abs("off") >= limit)
    at_peak, rest = WHY["desviacion_vs_patron"]
    why = F.when(F.col("peak_flag"), at_peak).otherwise(rest)
    return _shape(rows, "desviacion_vs_patron", F.col("off"), F.lit(limit), F.lit(1.5) + F.abs("off") * 4.0, why)


def union(parts: list[DataFrame]) -> DataFrame:
    """All detectors under one schema, with a severity by score and advice by type."""
    advice = F.create_map(*(F.lit(x) for kv in ADVICE.items() for x in kv))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumns({"severity": anomaly_severity("score"), "advice": advice[F.col("anomaly_type")]})


def with_precursors(anomalies: DataFrame, nodes: DataFrame, days: DataFrame, rows: int = 48, following: int = 7) -> DataFrame:
    """Whether the node is congested in its next ``rows`` rows, and the zone has an outage in its next ``following`` days, both from the anomaly on."""
    keys = ["ts", "zone_id", "station_id", "feeder_id"]
    ahead = Window.partitionBy("zone_id", "station_id", "feeder_id").orderBy("ts").rowsBetween(0, rows - 1)
    node = nodes.select(*keys, F.max(F.col("congested").cast("int")).over(ahead).alias("congestion_ahead"))
    soon = Window.partitionBy("zone_id").orderBy("day").rowsBetween(0, following - 1)
    zone = days.select("day", "zone_id", F.max((F.col("n_outages") > 0).cast("int")).over(soon).alias("outage_ahead"))
    out = anomalies.join(node, keys, "left").join(zone, ["day", "zone_id"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("congestion_ahead", "outage_ahead")})


def intensity(anomalies: DataFrame, by: str) -> DataFrame:
    return anomalies.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.sum((F.col("severity") == "critica").cast("int")).alias("critical"), F.avg("congestion_ahead").alias("congestion_share"), F.avg("outage_ahead").alias("outage_share"))
