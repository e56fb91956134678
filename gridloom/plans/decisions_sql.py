"""The forecasts, anomalies, scores and scenarios in DuckDB SQL."""

from __future__ import annotations

from gridloom.operators.forecasting import MODELS
from gridloom.operators.scoring import OPTIONS, SCENARIOS, SCORES, URGENCY


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


FORECAST = """
zone_series AS (SELECT CAST(s_nationkey AS BIGINT) AS zone_id, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS demand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
region_series AS (SELECT CAST(n_regionkey AS BIGINT) AS zone_id, day, sum(demand) AS demand FROM zone_series JOIN nation ON zone_id = n_nationkey GROUP BY 1, 2),
tasks AS (SELECT 'demanda_zona' AS task, * FROM zone_series UNION ALL SELECT 'demanda_region', * FROM region_series),
numbered AS (SELECT *, demand AS actual, row_number() OVER (PARTITION BY task, zone_id ORDER BY day) AS rn, count(*) OVER (PARTITION BY task, zone_id) AS n FROM tasks),
predicted AS (
  SELECT task, zone_id, day, actual, rn, n, lag(actual, 1) OVER w AS naive, coalesce(lag(actual, 7) OVER w, lag(actual, 1) OVER w) AS seasonal_naive,
         avg(actual) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS moving_average,
         regr_intercept(actual, rn) OVER (w ROWS BETWEEN 180 PRECEDING AND 1 PRECEDING) + regr_slope(actual, rn) OVER (w ROWS BETWEEN 180 PRECEDING AND 1 PRECEDING) * rn AS linear_trend,
         list(actual) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past
  FROM numbered WINDOW w AS (PARTITION BY task, zone_id ORDER BY day)),
held AS (SELECT * EXCLUDE (past), list_reduce(past, lambda a, v: 0.35::DOUBLE * v + 0.65::DOUBLE * a) AS exp_smoothing FROM predicted WHERE n >= 210 AND rn > n - 90),
errors AS (""" + "\nUNION ALL ".join(f"SELECT task, zone_id, day, actual, '{m}' AS model, {m} AS predicted, {m} - actual AS error FROM held" for m in MODELS) + """),
benchmark AS (
  SELECT task, model, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, avg(abs(error) / CASE WHEN abs(actual) + abs(predicted) = 0 THEN 1e-9 ELSE (abs(actual) + abs(predicted)) / 2 END) * 100 AS smape, avg(error) AS bias, count(*) AS n
  FROM errors GROUP BY 1, 2),
winners AS (SELECT task, model, mae FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(mae, 9), model) AS nth FROM benchmark) WHERE nth = 1),
predictability AS (
  SELECT *, median(mae) OVER () AS median_mae, CASE WHEN mae <= median(mae) OVER () THEN 'forecast_suficiente_para_diferir_capex' ELSE 'forecast_insuficiente_requiere_refuerzo_o_flex' END AS decision
  FROM (SELECT e.zone_id, e.mae, p.ev_mean, p.industry_mean, p.demand_mean, coalesce(ev_mean / nullif(demand_mean, 0), 0) AS ev_ratio, coalesce(industry_mean / nullif(demand_mean, 0), 0) AS industry_ratio,
               coalesce((ev_mean + industry_mean) / nullif(demand_mean, 0), 0) AS new_ratio
        FROM (SELECT zone_id, avg(abs(error)) AS mae FROM errors WHERE task = 'demanda_zona' AND model = (SELECT model FROM winners WHERE task = 'demanda_zona') GROUP BY 1) e
        LEFT JOIN (SELECT zone_id, avg(ev_mwh) AS ev_mean, avg(industry_mwh) AS industry_mean, avg(demand_mwh) AS demand_mean FROM zone_day GROUP BY 1) p USING (zone_id)))
""".strip()

ANOMALY = """
a_demand AS (
  SELECT ts, day, zone_id, station_id, feeder_id, 'demanda_inesperada' AS anomaly_type, demand_mw AS observed, mean_24 + 3 * spread AS threshold, abs(z) AS score,
         CASE WHEN residual > 0 THEN 'pico_no_esperado_posible_EV_o_industrial' ELSE 'caida_anomala_posible_reconfiguracion_o_fallo_medicion' END AS explanation
  FROM (SELECT *, coalesce(residual / nullif(spread, 0), 0) AS z FROM (SELECT *, stddev_samp(residual) OVER (PARTITION BY feeder_id) AS spread FROM (SELECT *, demand_mw - mean_24 AS residual FROM node_features))) WHERE abs(z) >= 3),
a_load AS (
  SELECT ts, day, zone_id, station_id, feeder_id, 'carga_relativa_anormal' AS anomaly_type, load_ratio AS observed, greatest(p, 1.15) AS threshold, 2.5 + greatest(load_ratio - 1, 0) * 10 AS score, 'saturacion_termica_o_desbalance_operativo' AS explanation
  FROM (SELECT *, quantile_cont(load_ratio, 0.99) OVER (PARTITION BY feeder_id) AS p FROM node_features) WHERE load_ratio >= p OR load_ratio >= 1.15::DOUBLE),
a_curtailment AS (
  SELECT ts, day, zone_id, station_id, feeder_id, 'curtailment_anormal' AS anomaly_type, cut AS observed, greatest(p, 0.18) AS threshold, 2 + cut * 8 AS score, 'exceso_GD_vs_capacidad_local_o_restriccion_operativa' AS explanation
  FROM (SELECT *, quantile_cont(cut, 0.99) OVER (PARTITION BY zone_id) AS p FROM (SELECT *, coalesce(curtailment_ratio, 0) AS cut FROM node_features)) WHERE cut >= p AND cut >= 0.18::DOUBLE),
a_ens AS (
  SELECT CAST(day AS TIMESTAMP) AS ts, day, zone_id, CAST(NULL AS BIGINT) AS station_id, CAST(NULL AS BIGINT) AS feeder_id, 'ens_atipica' AS anomaly_type, ens_mwh AS observed, lim AS threshold, 2 + coalesce(ens_mwh / nullif(lim, 0), 0) AS score,
         'degradacion_servicio_o_evento_meteo_con_impacto' AS explanation
  FROM (SELECT *, CASE WHEN count(ens_mwh) OVER w >= 7 THEN avg(ens_mwh) OVER w + 2.5 * coalesce(stddev_samp(ens_mwh) OVER w, 0) END AS lim FROM zone_day WINDOW w AS (PARTITION BY zone_id ORDER BY day ROWS 29 PRECEDING)) WHERE ens_mwh > lim AND ens_mwh > 0),
a_station AS (
  SELECT CAST(day AS TIMESTAMP) AS ts, day, zone_id, station_id, CAST(NULL AS BIGINT) AS feeder_id, 'deterioro_operativo_subestacion' AS anomaly_type, week AS observed, mon + 1.75 * dev AS threshold, 1.8 + greatest(week - mon, 0) * 10 AS score,
         'acumulacion_estres_y_posible_degradacion_activos' AS explanation
  FROM (SELECT *, CASE WHEN count(share) OVER w7 >= 5 THEN avg(share) OVER w7 END AS week, CASE WHEN count(share) OVER w30 >= 10 THEN avg(share) OVER w30 END AS mon,
               coalesce(CASE WHEN count(share) OVER w30 >= 10 THEN stddev_samp(share) OVER w30 END, 0) AS dev
        FROM (SELECT day, station_id, zone_id, avg(CASE WHEN load_ratio >= 0.95::DOUBLE OR congested THEN 1.0::DOUBLE ELSE 0 END) AS share FROM node_features GROUP BY 1, 2, 3)
        WINDOW w7 AS (PARTITION BY station_id ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY station_id ORDER BY day ROWS 29 PRECEDING)) WHERE week > mon + 1.75 * dev),
a_pattern AS (
  SELECT ts, day, zone_id, station_id, feeder_id, 'desviacion_vs_patron' AS anomaly_type, off AS observed, 0.35::DOUBLE AS threshold, 1.5 + abs(off) * 4 AS score,
         CASE WHEN peak_flag THEN 'desviacion_en_hora_punta_sensible' ELSE 'desviacion_fuera_patron_estacional' END AS explanation
  FROM (SELECT *, coalesce(vs_usual, 0) AS off FROM node_features) WHERE abs(off) >= 0.35::DOUBLE),
anomalies AS (
  SELECT *, CASE WHEN score >= 4 THEN 'critica' WHEN score >= 3 THEN 'alta' WHEN score >= 2 THEN 'media' ELSE 'baja' END AS severity,
         CASE anomaly_type WHEN 'demanda_inesperada' THEN 'monitorizar_intradia_y_activar_flex_rapida' WHEN 'carga_relativa_anormal' THEN 'reconfigurar_red_y_preparar_alivio' WHEN 'curtailment_anormal' THEN 'optimizar_despacho_GD_storage'
              WHEN 'ens_atipica' THEN 'activar_plan_resiliencia_servicio' WHEN 'deterioro_operativo_subestacion' THEN 'inspeccion_activos_y_mantenimiento_dirigido' ELSE 'validar_medicion_y_ajustar_modelo_operativo' END AS advice
  FROM (FROM a_demand UNION ALL FROM a_load UNION ALL FROM a_curtailment UNION ALL FROM a_ens UNION ALL FROM a_station UNION ALL FROM a_pattern)),
precursors AS (
  SELECT a.*, coalesce(n.congestion_ahead, 0) AS congestion_ahead, coalesce(z.outage_ahead, 0) AS outage_ahead FROM anomalies a
  LEFT JOIN (SELECT ts, zone_id, station_id, feeder_id, max(CAST(congested AS INT)) OVER (PARTITION BY zone_id, station_id, feeder_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING) AS congestion_ahead FROM node_state) n USING (ts, zone_id, station_id, feeder_id)
  LEFT JOIN (SELECT day, zone_id, max(CAST(n_outages > 0 AS INT)) OVER (PARTITION BY zone_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS outage_ahead FROM zone_day) z ON z.day = a.day AND z.zone_id = a.zone_id),
zone_intensity AS (SELECT zone_id, count(*) AS n, avg(score) AS mean_score, count_if(severity = 'critica') AS critical, avg(congestion_ahead) AS congestion_share, avg(outage_ahead) AS outage_share FROM precursors GROUP BY 1)
""".strip()


def _scaled(name: str) -> str:
    low, high = f"min({name}) OVER ()", f"max({name}) OVER ()"
    return f"(CASE WHEN {high} = {low} THEN 50.0::DOUBLE ELSE 100 * ({name} - {low}) / ({high} - {low}) END)"


def _sum(parts: dict[str, float]) -> str:
    return " + ".join(f"{_d(w)} * " + (f"(100 - {_scaled(n[1:])})" if n[0] == "-" else _scaled(n)) for n, w in parts.items())


def _plain(parts: dict[str, float]) -> str:
    return " + ".join(f"{_d(w)} * {n}" for n, w in parts.items())


SCORE = f"""
score_raw AS (
  SELECT m.*, d.* EXCLUDE (zone_id), g.* EXCLUDE (zone_id), a.* EXCLUDE (zone_id), c.* EXCLUDE (zone_id), i.mean_score, i.critical, i.congestion_share, i.outage_share, f.mae, f.new_ratio, f.decision
  FROM (SELECT zone_id, avg(congested_hours) AS congested_hours, avg(peak_mw) AS peak_mw, avg(resilience) AS resilience, avg(capex_intensity) AS capex_intensity, avg(growth_tension) AS growth, avg(ev_mwh + industry_mwh) AS new_demand_mwh FROM zone_month_features GROUP BY 1) m
  LEFT JOIN (SELECT zone_id, avg(ens_mwh) AS ens_mean, avg(customers) AS customers_mean, avg(risk_cost) AS risk_cost, avg(unserved_mwh) AS unserved_mwh, avg(flex_gap_mwh) AS flex_gap_mwh FROM zone_day_features GROUP BY 1) d USING (zone_id)
  LEFT JOIN (SELECT zone_id, gap_mw, economic_gap, flex_ratio, congested_hours AS congested_total FROM flex_gap) g USING (zone_id)
  LEFT JOIN (SELECT zone_id, avg(exposure_score) AS exposure, avg(adjusted_p) AS adjusted_p, sum(station_ens_mwh) AS exposed_ens FROM asset_exposure GROUP BY 1) a USING (zone_id)
  LEFT JOIN (SELECT zone_id, avg(capex) AS capex_mean, sum(capex) AS capex_total, avg(horizon_months) AS mean_horizon FROM candidates GROUP BY 1) c USING (zone_id)
  LEFT JOIN zone_intensity i USING (zone_id) LEFT JOIN predictability f USING (zone_id)),
score_base AS (SELECT zone_id, coalesce(decision, 'forecast_no_disponible') AS decision, coalesce(CAST(COLUMNS(* EXCLUDE (zone_id, decision)) AS DOUBLE), 0) FROM score_raw),
scores AS (SELECT *, {_plain(URGENCY)} AS urgency FROM (SELECT *, {", ".join(f"{_sum(parts)} AS {name}" for name, parts in SCORES.items())} FROM score_base)),
options AS (
  SELECT *, 0.40::DOUBLE * impact + 0.20::DOUBLE * (100 - 100 * (cost - min(cost) OVER w) / (max(cost) OVER w - min(cost) OVER w + 1e-9))
         + 0.15::DOUBLE * (100 - 100 * ("time" - min("time") OVER w) / (max("time") OVER w - min("time") OVER w + 1e-9)) + 0.15::DOUBLE * urgency + 0.10::DOUBLE * (100 * robustness) AS option_score
  FROM ({" UNION ALL ".join(f"SELECT zone_id, urgency, {i} AS nth, '{o}' AS option, {_plain(parts)} AS impact, {_d(cost)} * capex_total AS cost, {_d(time)} * mean_horizon AS time, {_d(robust)} AS robustness FROM scores" for i, (o, (parts, cost, time, robust)) in enumerate(OPTIONS.items()))})
  WINDOW w AS (PARTITION BY zone_id)),
ranking AS (
  SELECT *, CASE WHEN priority >= 80 THEN 'critico' WHEN priority >= 60 THEN 'alto' WHEN priority >= 40 THEN 'medio' ELSE 'bajo' END AS tier,
         CASE WHEN priority >= 85 THEN 'inmediata' WHEN priority >= 70 THEN 'alta' WHEN priority >= 55 THEN 'planificada' ELSE 'monitorizacion' END AS urgency_tier,
         CASE intervention WHEN 'intervencion_inmediata_prioritaria' THEN '0-6m' WHEN 'sustituir_activos' THEN '0-12m' WHEN 'reforzar_red_local' THEN '6-24m' WHEN 'desplegar_almacenamiento' THEN '3-12m' WHEN 'activar_flexibilidad' THEN '0-6m'
              WHEN 'optimizar_operacion' THEN '0-3m' ELSE 'revision_trimestral' END AS sequence,
         CASE greatest({", ".join(SCORES)}) {" ".join(f"WHEN {s} THEN '{s}'" for s in SCORES)} END AS driver,
         CASE WHEN mae <= median(mae) OVER () THEN 'alta_confianza' ELSE 'media_confianza_requiere_seguimiento' END AS confidence
  FROM (SELECT *, CASE WHEN priority < 45 THEN 'monitorizar' WHEN priority >= 90 THEN 'intervencion_inmediata_prioritaria' WHEN asset_exposure_score >= 75 THEN 'sustituir_activos' WHEN option = 'refuerzo_red' THEN 'reforzar_red_local'
                       WHEN option = 'flexibilidad' THEN 'activar_flexibilidad' WHEN option = 'almacenamiento' THEN 'desplegar_almacenamiento' ELSE 'optimizar_operacion' END AS intervention
        FROM (SELECT s.*, o.option, o.option_score, least(greatest(0.74::DOUBLE * s.urgency + 0.26::DOUBLE * o.option_score, 0), 100) AS priority
              FROM scores s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY option_score DESC, nth) AS best FROM options) WHERE best = 1) o USING (zone_id)))),
scenario_factors(scenario, load_f, congestion_f, ens_f, curtailment_f, flex_f, risk_f, capex_f, priority_f) AS (VALUES {", ".join("('" + s + "', " + ", ".join(_d(v) for v in values) + ")" for s, values in SCENARIOS.items())}),
scenarios AS (
  SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY scenario_priority DESC, zone_id) AS rank
  FROM (SELECT f.scenario, r.zone_id, r.tier, r.intervention, r.peak_mw * load_f AS load, r.congested_hours * congestion_f AS congestion, r.ens_mean * ens_f AS ens, coalesce(m.curtailment_base, 0) * curtailment_f AS curtailment,
               r.flex_gap_mwh * flex_f AS flex_gap, r.risk_cost * risk_f AS cost, r.capex_total * capex_f + 0.2::DOUBLE * r.capex_intensity * greatest(flex_f, 1) AS investment, least(greatest(r.priority * priority_f, 0), 100) AS scenario_priority
        FROM ranking r CROSS JOIN scenario_factors f LEFT JOIN (SELECT zone_id, avg(curtailment_mwh) AS curtailment_base FROM zone_month_features GROUP BY 1) m ON m.zone_id = r.zone_id)),
scenario_summary AS (SELECT scenario, avg(load) AS load, sum(congestion) AS congestion, sum(ens) AS ens, sum(curtailment) AS curtailment, sum(flex_gap) AS flex_gap, sum(cost) AS cost, sum(investment) AS investment, avg(scenario_priority) AS scenario_priority FROM scenarios GROUP BY 1)
""".strip()


def _held(name: str, series: str, by: str, at: str, period: int, window: int, horizon: int) -> str:
    """The held-out rows of ``series`` with each model's prediction."""
    before = lambda n: f"OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_numbered AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {at}) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {series}),
{name}_predicted AS (
  SELECT *, lag(actual, 1) OVER w AS naive, coalesce(lag(actual, {period}) OVER w, lag(actual, 1) OVER w) AS seasonal_naive, avg(actual) {before(window)} AS moving_average,
         regr_intercept(actual, rn) {before(180)} + regr_slope(actual, rn) {before(180)} * rn AS linear_trend, list(actual) {before('UNBOUNDED')} AS past
  FROM {name}_numbered WINDOW w AS (PARTITION BY {by} ORDER BY {at})),
{name} AS (SELECT * EXCLUDE (past), list_reduce(past, lambda a, v: 0.35::DOUBLE * v + 0.65::DOUBLE * a) AS exp_smoothing FROM {name}_predicted WHERE n >= {horizon + 120} AND rn > n - {horizon}),
{name}_errors AS (""" + "\nUNION ALL ".join(f"SELECT *, '{m}' AS model, {m} AS predicted, {m} - actual AS error FROM {name}" for m in MODELS) + ")"


TASKS = ("""
day_series AS (SELECT task, entity, day, CAST(value AS DOUBLE) AS actual FROM series),
hour_series AS (SELECT zone_id, ts, value AS actual, peak FROM hours),"""
         + _held("day_held", "day_series", "task, entity", "day", 7, 7, 90) + "," + _held("hour_held", "hour_series", "zone_id", "ts", 24, 24, 504) + """,
task_benchmark AS (
  SELECT task, model, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, avg(abs(error) / CASE WHEN abs(actual) + abs(predicted) = 0 THEN 1e-9 ELSE (abs(actual) + abs(predicted)) / 2 END) * 100 AS smape, avg(error) AS bias, count(*) AS n
  FROM day_held_errors GROUP BY 1, 2),
task_winners AS (SELECT task, model, mae FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(mae, 9), model) AS nth FROM task_benchmark) WHERE nth = 1)""")

ALL = ",\n".join((FORECAST, ANOMALY, SCORE))
