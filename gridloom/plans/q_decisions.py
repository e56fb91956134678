"""Queries of forecasts, anomalies, scores and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import anomalies, scoring
from gridloom.operators.forecasting import metrics
from gridloom.operators.scoring import SCORES, URGENCY
from gridloom.plans.decisions_sql import ALL, ANOMALY, FORECAST, TASKS
from gridloom.plans.marts_sql import rounded
from gridloom.plans.query import NUDGE, Query

SEEN = "^ts @day zone_id station_id feeder_id anomaly_type ~observed ~threshold ~score explanation"
SEVEN = " ".join(f"~{s}:3" for s in SCORES)


def _part(name: str, table: str) -> Query:
    return Query(name, SEEN, lambda m: m.detected(table.removeprefix("a_")), f"SELECT * FROM {table}", more=ANOMALY)


_moved = list(URGENCY)[:2]
_alternative = " + ".join(f"{w!r}::DOUBLE * {'factor * ' if s in _moved else ''}{s}" for s, w in URGENCY.items())

QUERIES = [
    Query("fc_naive_seasonal_ma", "zone_id @day ~actual ~naive ~seasonal_naive ~moving_average", lambda m: m.zone_forecast, "SELECT * FROM held WHERE task = 'demanda_zona'", more=FORECAST),
    Query("fc_linear_trend", "zone_id @day ~actual ~linear_trend", lambda m: m.zone_forecast, "SELECT * FROM held WHERE task = 'demanda_zona'", more=FORECAST),
    Query("fc_exp_smoothing", "zone_id @day ~actual ~exp_smoothing", lambda m: m.zone_forecast, "SELECT * FROM held WHERE task = 'demanda_zona'", more=FORECAST),
    Query("fc_benchmark", "task model ~mae ~rmse ~smape ~bias #n", lambda m: m.benchmark, "SELECT * FROM benchmark", more=FORECAST),
    Query("fc_winner", "task model ~mae", lambda m: m.winners, "SELECT * FROM winners", more=FORECAST),
    Query("fc_error_zone", "zone_id ~mae ~rmse ~smape ~bias ~mean_actual", lambda m: m.best_zone_errors.groupBy("zone_id").agg(*metrics(), F.avg("actual").alias("mean_actual")),
          "SELECT zone_id, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, avg(abs(error) / CASE WHEN abs(actual) + abs(predicted) = 0 THEN 1e-9 ELSE (abs(actual) + abs(predicted)) / 2 END) * 100 AS smape, avg(error) AS bias, avg(actual) AS mean_actual FROM errors WHERE task = 'demanda_zona' AND model = (SELECT model FROM winners WHERE task = 'demanda_zona') GROUP BY 1", more=FORECAST),
    Query("fc_error_peak", "model ~mae_peak ~rmse_peak ~smape_peak ~bias_peak ~mae_all ~rmse_all ~smape_all ~bias_all", lambda m: m.hour_peak_errors,
          "SELECT model, avg(abs(error)) FILTER (peak) AS mae_peak, sqrt(avg(error * error) FILTER (peak)) AS rmse_peak, avg(abs(error) / CASE WHEN abs(actual) + abs(predicted) = 0 THEN 1e-9 ELSE (abs(actual) + abs(predicted)) / 2 END) FILTER (peak) * 100 AS smape_peak, avg(error) FILTER (peak) AS bias_peak, avg(abs(error)) AS mae_all, sqrt(avg(error * error)) AS rmse_all, avg(abs(error) / CASE WHEN abs(actual) + abs(predicted) = 0 THEN 1e-9 ELSE (abs(actual) + abs(predicted)) / 2 END) * 100 AS smape_all, avg(error) AS bias_all FROM hour_held_errors GROUP BY 1", more=TASKS),
    Query("fc_predictability", "zone_id ~mae ~ev_ratio ~industry_ratio ~new_ratio decision", lambda m: m.predictability, "SELECT * FROM predictability", more=FORECAST),
    Query("fc_tasks_daily", "task entity @day ~actual ~naive ~seasonal_naive ~moving_average ~linear_trend ~exp_smoothing", lambda m: m.day_forecast, "SELECT * FROM day_held", more=TASKS),
    Query("fc_tasks_benchmark", "task model ~mae ~rmse ~smape ~bias #n", lambda m: m.task_benchmark, "SELECT * FROM task_benchmark", more=TASKS),
    Query("fc_tasks_winner", "task model ~mae", lambda m: m.task_winners, "SELECT * FROM task_winners", more=TASKS),
    Query("fc_error_zone_type", "zone_type ~mae ~rmse ~smape ~bias #n", lambda m: m.zone_type_errors,
          "SELECT zone_type, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, avg(abs(error) / CASE WHEN abs(actual) + abs(predicted) = 0 THEN 1e-9 ELSE (abs(actual) + abs(predicted)) / 2 END) * 100 AS smape, avg(error) AS bias, count(*) AS n FROM day_held_errors LEFT JOIN zones ON entity = CAST(zone_id AS VARCHAR) WHERE task = 'demanda_zona' AND model = (SELECT model FROM task_winners WHERE task = 'demanda_zona') GROUP BY 1", more=TASKS),
    Query("fc_hourly", "zone_id ^ts peak ~actual ~naive ~seasonal_naive ~moving_average ~linear_trend ~exp_smoothing", lambda m: m.hour_forecast, "SELECT * FROM hour_held", more=TASKS),
    Query("fc_hourly_peak", "zone_id model ~mae_peak ~rmse_peak ~mae_all ~rmse_all #n", lambda m: m.zone_peak_errors,
          "SELECT zone_id, model, avg(abs(error)) FILTER (peak) AS mae_peak, sqrt(avg(error * error) FILTER (peak)) AS rmse_peak, avg(abs(error)) AS mae_all, sqrt(avg(error * error)) AS rmse_all, count(*) AS n FROM hour_held_errors GROUP BY 1, 2", more=TASKS),
    _part("anom_demand_z", "a_demand"), _part("anom_load_p99", "a_load"), _part("anom_curtailment", "a_curtailment"), _part("anom_ens_roll", "a_ens"), _part("anom_substation_trend", "a_station"), _part("anom_baseline_dev", "a_pattern"),
    Query("anom_union_severity", f"{SEEN} severity advice", lambda m: m.anomalies, "SELECT * FROM anomalies", more=ANOMALY),
    Query("anom_ids", "anomaly_id #nth ^ts zone_id station_id feeder_id anomaly_type ~score severity", lambda m: m.anomaly_ids,
          f"SELECT *, 'ANOM_' || lpad(CAST(nth AS VARCHAR), 7, '0') AS anomaly_id FROM (SELECT *, row_number() OVER (ORDER BY {rounded('score', 4, NUDGE)} DESC, ts, anomaly_type, zone_id, station_id NULLS FIRST, feeder_id NULLS FIRST) AS nth FROM anomalies)", more=ANOMALY),
    Query("anom_precursors", "^ts zone_id station_id feeder_id anomaly_type ~score severity congestion_ahead outage_ahead", lambda m: m.precursors, "SELECT * FROM precursors", more=ANOMALY),
    Query("anom_zone_intensity", "zone_id #n ~mean_score #critical ~congestion_share ~outage_share", lambda m: m.zone_intensity, "SELECT * FROM zone_intensity", more=ANOMALY),
    Query("anom_type_summary", "anomaly_type #n ~mean_score ~congestion_share ~outage_share", lambda m: anomalies.intensity(m.precursors, "anomaly_type"), "SELECT anomaly_type, count(*) AS n, avg(score) AS mean_score, avg(congestion_ahead) AS congestion_share, avg(outage_ahead) AS outage_share FROM precursors GROUP BY 1", more=ANOMALY),
    Query("score_seven", f"zone_id decision {SEVEN} ~urgency:3", lambda m: m.scores, "SELECT * FROM scores", more=ALL),
    Query("score_options_best", "zone_id option ~impact:3 ~cost:2 ~time:3 ~robustness ~option_score:3", lambda m: m.options, "SELECT * FROM options", more=ALL),
    Query("score_priority_rules", "zone_id option ~option_score:3 ~priority:3 tier urgency_tier intervention sequence driver confidence", lambda m: m.ranking, "SELECT * FROM ranking", more=ALL),
    Query("score_sensitivity", "zone_id ~factor ~alternative:3 #rank", lambda m: m.sensitivity, f"SELECT *, row_number() OVER (PARTITION BY factor ORDER BY alternative DESC, zone_id) AS rank FROM (SELECT s.zone_id, f.factor, {_alternative} AS alternative FROM scores s CROSS JOIN (VALUES (0.9::DOUBLE), (1.1::DOUBLE)) f(factor))", more=ALL),
    Query("scenario_impacts", "scenario zone_id tier intervention ~load ~congestion ~ens ~curtailment ~flex_gap ~cost:2 ~investment:2 ~scenario_priority:3 #rank", lambda m: m.scenarios, "SELECT * FROM scenarios", more=ALL),
    Query("scenario_summary", "scenario ~load ~congestion ~ens ~curtailment ~flex_gap ~cost:2 ~investment:2 ~scenario_priority:3", lambda m: m.scenario_summary, "SELECT * FROM scenario_summary", more=ALL),
    Query("scenario_top15", "scenario zone_id #rank ~scenario_priority:3", lambda m: m.scenarios.where("rank <= 15"), "SELECT * FROM scenarios WHERE rank <= 15", more=ALL),
    Query("what_if", "zone_id ~priority:3 ~simulated:3 ~adjusted_gap:3 action", lambda m: scoring.what_if(m.ranking, 20, 15, 10, 10),
          "SELECT *, CASE WHEN simulated >= 85 THEN 'intervencion_inmediata_prioritaria' WHEN simulated >= 74 AND adjusted_gap >= 58 THEN 'reforzar_red_local' WHEN simulated >= 62 AND adjusted_gap >= 48 THEN 'desplegar_almacenamiento' WHEN simulated >= 52 THEN 'activar_flexibilidad' ELSE 'optimizar_operacion' END AS action "
          "FROM (SELECT *, flexibility_gap_score * (1 - 0.06::DOUBLE - 0.045::DOUBLE) AS adjusted_gap, least(greatest(0.58::DOUBLE * priority + 0.24::DOUBLE * electrification_pressure_score * (1 + 0.12::DOUBLE + 0.06::DOUBLE) + 0.18::DOUBLE * flexibility_gap_score * (1 - 0.06::DOUBLE - 0.045::DOUBLE), 0), 100) AS simulated FROM ranking)", more=ALL),
]
