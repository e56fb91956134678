"""The domain's own files: CSV with declared schemas, Parquet landing, writers and an export catalogue."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns and types of the fifteen files.
FILES: dict[str, str] = {
    "zonas_red": "zona_id string, zona_nombre string, comunidad_autonoma string, provincia string, tipo_zona string, region_operativa string, densidad_demanda double, penetracion_generacion_distribuida double, criticidad_territorial double, potencial_flexibilidad double, riesgo_climatico double, tension_crecimiento_demanda double",
    "subestaciones": "subestacion_id string, zona_id string, nombre_subestacion string, capacidad_mw double, capacidad_firme_mw double, antiguedad_anios int, indice_criticidad double, digitalizacion_nivel double, redundancia_nivel double",
    "alimentadores": "alimentador_id string, subestacion_id string, tipo_red string, capacidad_mw double, longitud_km double, nivel_perdidas_estimado double, exposicion_climatica double, carga_base_esperada double, criticidad_operativa double",
    "demanda_horaria": "timestamp timestamp_ntz, zona_id string, subestacion_id string, alimentador_id string, demanda_mw double, demanda_reactiva_proxy double, temperatura double, humedad double, tipo_dia string, mes int, hora int, factor_estacional double, hora_punta_flag boolean, tension_sistema_proxy double",
    "generacion_distribuida": "timestamp timestamp_ntz, zona_id string, tecnologia string, capacidad_instalada_mw double, generacion_mw double, autoconsumo_estimado_mw double, vertido_estimado_mw double, curtailment_estimado_mw double",
    "demanda_ev": "timestamp timestamp_ntz, zona_id string, tipo_recarga string, demanda_ev_mw double, penetracion_ev double, horario_recarga_dominante string",
    "demanda_electrificacion_industrial": "timestamp timestamp_ntz, zona_id string, cluster_industrial string, demanda_industrial_adicional_mw double, perfil_operativo string, elasticidad_flexibilidad_proxy double",
    "eventos_congestion": "evento_id string, timestamp_inicio timestamp_ntz, timestamp_fin timestamp_ntz, zona_id string, subestacion_id string, alimentador_id string, severidad string, energia_afectada_mwh double, carga_relativa_max double, causa_principal string, impacto_servicio_flag boolean",
    "interrupciones_servicio": "interrupcion_id string, timestamp_inicio timestamp_ntz, timestamp_fin timestamp_ntz, zona_id string, subestacion_id string, clientes_afectados bigint, energia_no_suministrada_mwh double, causa string, nivel_severidad string, relacion_congestion_flag boolean",
    "activos_red": "activo_id string, tipo_activo string, subestacion_id string, alimentador_id string, edad_anios int, estado_salud double, probabilidad_fallo_proxy double, criticidad double, capex_reposicion_estimado double, opex_mantenimiento_estimado double",
    "recursos_flexibilidad": "recurso_id string, zona_id string, tipo_recurso string, capacidad_flexible_mw double, coste_activacion_eur_mwh double, tiempo_respuesta_min int, disponibilidad_media double, fiabilidad_activacion double, madurez_operativa double",
    "almacenamiento_distribuido": "storage_id string, zona_id string, capacidad_energia_mwh double, capacidad_potencia_mw double, eficiencia_roundtrip double, coste_operacion_proxy double, disponibilidad_media double",
    "intervenciones_operativas": "intervencion_id string, zona_id string, tipo_intervencion string, capacidad_alivio_estimado_mw double, coste_estimado double, tiempo_despliegue_dias int, complejidad_operativa double",
    "inversiones_posibles": "inversion_id string, zona_id string, tipo_inversion string, capex_estimado double, opex_incremental_estimado double, reduccion_riesgo_esperada double, aumento_capacidad_esperado double, horizonte_meses int, facilidad_implementacion double, impacto_resiliencia double",
    "escenario_macro": "fecha date, escenario string, crecimiento_demanda_indice double, penetracion_ev_indice double, electrificacion_industrial_indice double, presion_capex_indice double",
}
#: Role, its file, and the plan's column for each of the file's columns that it uses.
FRAMES: dict[str, tuple[str, dict[str, str]]] = {
    "zones": ("zonas_red", {"zona_id": "zone_id", "zona_nombre": "zone_name", "region_operativa": "region", "tipo_zona": "zone_type", "criticidad_territorial": "criticality", "potencial_flexibilidad": "flex_potential", "riesgo_climatico": "climate_risk", "tension_crecimiento_demanda": "growth_tension"}),
    "substations": ("subestaciones", {"subestacion_id": "station_id", "zona_id": "zone_id", "capacidad_mw": "capacity_mw", "capacidad_firme_mw": "firm_mw", "antiguedad_anios": "age_years"}),
    "feeders": ("alimentadores", {"alimentador_id": "feeder_id", "subestacion_id": "station_id", "tipo_red": "grid_type", "capacidad_mw": "capacity_mw", "exposicion_climatica": "climate_exposure", "carga_base_esperada": "base_load_mw"}),
    "demand": ("demanda_horaria", {"timestamp": "ts", "zona_id": "zone_id", "subestacion_id": "station_id", "alimentador_id": "feeder_id", "demanda_mw": "demand_mw", "temperatura": "temperature", "tipo_dia": "day_type", "hora": "hour_of_day", "hora_punta_flag": "peak_flag", "tension_sistema_proxy": "voltage", "demanda_reactiva_proxy": "reactive_mw", "mes": "month_of_year"}),
    "generation": ("generacion_distribuida", {"timestamp": "ts", "zona_id": "zone_id", "tecnologia": "technology", "generacion_mw": "generation_mw", "curtailment_estimado_mw": "curtailment_mw", "autoconsumo_estimado_mw": "self_use_mw", "vertido_estimado_mw": "spill_mw"}),
    "ev": ("demanda_ev", {"timestamp": "ts", "zona_id": "zone_id", "tipo_recarga": "charging_type", "demanda_ev_mw": "ev_mw"}),
    "industry": ("demanda_electrificacion_industrial", {"timestamp": "ts", "zona_id": "zone_id", "cluster_industrial": "cluster", "demanda_industrial_adicional_mw": "industry_mw"}),
    "congestion": ("eventos_congestion", {"evento_id": "event_id", "timestamp_inicio": "ts_start", "timestamp_fin": "ts_end", "zona_id": "zone_id", "subestacion_id": "station_id", "alimentador_id": "feeder_id", "severidad": "severity", "energia_afectada_mwh": "energy_mwh", "impacto_servicio_flag": "service_flag", "carga_relativa_max": "max_ratio"}),
    "outages": ("interrupciones_servicio", {"interrupcion_id": "outage_id", "timestamp_inicio": "ts_start", "timestamp_fin": "ts_end", "zona_id": "zone_id", "subestacion_id": "station_id", "clientes_afectados": "customers", "energia_no_suministrada_mwh": "ens_mwh", "nivel_severidad": "severity", "relacion_congestion_flag": "congestion_flag"}),
    "assets": ("activos_red", {"activo_id": "asset_id", "tipo_activo": "asset_type", "subestacion_id": "station_id", "alimentador_id": "feeder_id", "edad_anios": "age_years", "estado_salud": "health", "probabilidad_fallo_proxy": "failure_p", "criticidad": "criticality", "capex_reposicion_estimado": "capex"}),
    "flexibility": ("recursos_flexibilidad", {"recurso_id": "resource_id", "zona_id": "zone_id", "capacidad_flexible_mw": "flex_mw", "coste_activacion_eur_mwh": "cost_eur_mwh", "disponibilidad_media": "availability", "fiabilidad_activacion": "reliability", "madurez_operativa": "maturity"}),
    "storage": ("almacenamiento_distribuido", {"storage_id": "storage_id", "zona_id": "zone_id", "capacidad_energia_mwh": "energy_mwh", "capacidad_potencia_mw": "power_mw", "disponibilidad_media": "availability", "eficiencia_roundtrip": "efficiency"}),
    "interventions": ("intervenciones_operativas", {"intervencion_id": "intervention_id", "zona_id": "zone_id", "capacidad_alivio_estimado_mw": "relief_mw", "coste_estimado": "cost", "tiempo_despliegue_dias": "days", "complejidad_operativa": "complexity"}),
    "investments": ("inversiones_posibles", {"inversion_id": "investment_id", "zona_id": "zone_id", "tipo_inversion": "investment_type", "capex_estimado": "capex", "reduccion_riesgo_esperada": "risk_reduction", "aumento_capacidad_esperado": "capacity_gain", "horizonte_meses": "horizon_months", "facilidad_implementacion": "ease", "impacto_resiliencia": "resilience"}),
    "macro": ("escenario_macro", {"fecha": "day", "escenario": "scenario", "crecimiento_demanda_indice": "growth_index", "penetracion_ev_indice": "ev_index"}),
}


def schema(table: str) -> str:
    """The declared schema of a file."""
    return FILES[table].replace("timestamp timestamp_ntz", "`timestamp` timestamp_ntz")


def describe(tables: Iterable[str] = FILES) -> list[tuple[str, str, str]]:
    """Table, column and type of every declared column."""
    return [(t, *c.split(" ")) for t in tables for c in FILES[t].split(", ")]


def read_csv(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A domain CSV with header by its declared schema, never inferred; a header that differs fails."""
    return spark.read.schema(schema(table)).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(f"{folder}/{table}.csv")


def land(spark: SparkSession, folder: str, out: str, tables: Iterable[str] = FILES) -> None:
    """Write the CSV files as Parquet once, so later scans prune columns and rows. The demand is dealt by month."""
    for table in tables:
        df = read_csv(spark, folder, table)
        if table == "demanda_horaria":
            df.withColumn("month_of", F.date_format("timestamp", "yyyy-MM")).write.partitionBy("month_of").mode("overwrite").parquet(f"{out}/{table}.parquet")
        else:
            df.write.mode("overwrite").parquet(f"{out}/{table}.parquet")


def frame(spark: SparkSession, folder: str, role: str) -> DataFrame:
    """A domain frame under the plans' column names, from landed Parquet."""
    table, names = FRAMES[role]
    df = spark.read.parquet(f"{folder}/{table}.parquet").select(*(F.col(a).alias(b) for a, b in names.items()))
    return df.withColumn("day_no", F.dayofyear("day")).drop("day") if role == "macro" else df


def register(spark: SparkSession, folder: str, tables: Iterable[str] = FILES) -> None:
    """One view for each CSV file."""
    for table in tables:
        read_csv(spark, folder, table).createOrReplaceTempView(table)


def write(df: DataFrame, path: str, single: bool = False) -> None:
    """By the path's suffix: Parquet, JSON lines, or else CSV with a header. ``single``: one file, for small results."""
    out = (df.coalesce(1) if single else df).write.mode("overwrite")
    if path.endswith(".parquet"):
        out.parquet(path)
    elif path.endswith(".json"):
        out.json(path)
    else:
        out.option("header", True).csv(path)


def export(frames: dict[str, Callable[[], DataFrame]], folder: str, kind: str = "parquet") -> list[str]:
    """Write every frame of a catalogue; gives the paths."""
    paths = [f"{folder}/{name}.{kind}" for name in frames]
    for path, make in zip(paths, frames.values(), strict=True):
        write(make(), path)
    return paths
