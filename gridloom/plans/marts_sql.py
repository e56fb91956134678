"""The layers of ``marts`` in DuckDB SQL, as common table expressions for the oracles."""

from __future__ import annotations

from gridloom.sources.tables import role_sql


def rounded(x: str, digits: int = 4, nudge: float = 0.0) -> str:
    by = f"{10**digits}.0::DOUBLE"
    return f"(sign({x}) * floor(abs({x}) * {by} + {0.5 + nudge}::DOUBLE) / {by} + 0.0::DOUBLE)"


LAYERS = """
zone_hour AS (
  SELECT b.*, coalesce(g.generation_mw, 0) AS generation_mw, coalesce(g.curtailment_mw, 0) AS curtailment_mw, coalesce(e.ev_mw, 0) AS ev_mw,
         coalesce(i.industry_mw, 0) AS industry_mw, coalesce(m.growth_index, 1) AS growth_index, coalesce(m.ev_index, 1) AS ev_index
  FROM (SELECT ts, zone_id, sum(demand_mw) AS zone_demand_mw, max(demand_mw) AS top_feeder_mw FROM demand GROUP BY ALL) b
  LEFT JOIN (SELECT ts, zone_id, sum(generation_mw) AS generation_mw, sum(curtailment_mw) AS curtailment_mw FROM generation GROUP BY ALL) g USING (ts, zone_id)
  LEFT JOIN (SELECT ts, zone_id, sum(ev_mw) AS ev_mw FROM ev GROUP BY ALL) e USING (ts, zone_id)
  LEFT JOIN (SELECT ts, zone_id, sum(industry_mw) AS industry_mw FROM industry GROUP BY ALL) i USING (ts, zone_id)
  LEFT JOIN macro m ON m.scenario = 'base' AND m.day_no = dayofyear(b.ts)),
feeder_shares AS (
  SELECT f.*, s.zone_id, f.capacity_mw / nullif(sum(f.capacity_mw) OVER (PARTITION BY s.zone_id), 0) AS capacity_share
  FROM feeders f JOIN substations s USING (station_id) JOIN zones z ON z.zone_id = s.zone_id),
node_load AS (
  SELECT d.*, f.grid_type, f.capacity_mw, f.climate_exposure, f.capacity_share, h.zone_demand_mw, h.top_feeder_mw, h.generation_mw, h.curtailment_mw, h.ev_mw, h.industry_mw,
         h.growth_index, h.ev_index, d.demand_mw / nullif(h.zone_demand_mw, 0) AS demand_share, d.demand_mw / nullif(f.capacity_mw, 0) AS load_ratio,
         h.ev_mw * (d.demand_mw / nullif(h.zone_demand_mw, 0)) AS ev_alloc_mw, h.industry_mw * (d.demand_mw / nullif(h.zone_demand_mw, 0)) AS industry_alloc_mw,
         h.generation_mw * f.capacity_share AS generation_alloc_mw, h.curtailment_mw * f.capacity_share AS curtailment_alloc_mw,
         d.demand_mw - h.generation_mw * f.capacity_share AS net_load_mw, greatest(d.demand_mw - f.capacity_mw, 0) AS overload_mw
  FROM demand d JOIN feeder_shares f USING (feeder_id, station_id, zone_id) LEFT JOIN zone_hour h ON h.ts = d.ts AND h.zone_id = d.zone_id),
ranked_events AS (
  SELECT *, CASE severity WHEN 'critica' THEN 4 WHEN 'alta' THEN 3 WHEN 'media' THEN 2 ELSE 1 END AS severity_rank, greatest(date_diff('hour', ts_start, ts_end) + 1, 1) AS hours
  FROM congestion),
event_hours AS (
  SELECT e.*, g.ts, e.energy_mwh / nullif(e.hours, 0) AS hour_energy_mwh FROM ranked_events e, LATERAL (SELECT unnest(generate_series(e.ts_start, e.ts_end, INTERVAL 1 HOUR)) AS ts) g),
ranked_outages AS (
  SELECT *, CASE severity WHEN 'critica' THEN 4 WHEN 'alta' THEN 3 WHEN 'media' THEN 2 ELSE 1 END AS severity_rank, greatest(date_diff('minute', ts_start, ts_end) + 1, 1) AS minutes FROM outages),
outage_overlaps AS (
  SELECT o.*, coalesce(x.n_events, 0) AS n_events, coalesce(x.max_event_rank, 0) AS max_event_rank, coalesce(x.event_energy_mwh, 0) AS event_energy_mwh, coalesce(x.n_events, 0) > 0 AS overlap_flag
  FROM ranked_outages o LEFT JOIN (
    SELECT a.outage_id, count(DISTINCT b.event_id) AS n_events, max(b.severity_rank) AS max_event_rank, sum(b.energy_mwh) AS event_energy_mwh
    FROM ranked_outages a JOIN ranked_events b ON a.station_id = b.station_id AND b.ts_start <= a.ts_end AND b.ts_end + INTERVAL 1 HOUR >= a.ts_start GROUP BY 1) x USING (outage_id)),
flex_zone AS (
  SELECT z.*, coalesce(p.peak_mw, 0) AS peak_mw, coalesce(p.mean_mw, 0) AS mean_mw, coalesce(c.feeders_mw, 0) AS feeders_mw, coalesce(c.stations_mw, 0) AS stations_mw,
         coalesce(c.stations_firm_mw, 0) AS stations_firm_mw, coalesce(f.flex_mw, 0) AS flex_mw, coalesce(f.flex_cost, 0) AS flex_cost, coalesce(f.flex_availability, 0) AS flex_availability,
         coalesce(s.storage_mw, 0) AS storage_mw, coalesce(s.storage_mwh, 0) AS storage_mwh, coalesce(s.storage_availability, 0) AS storage_availability,
         coalesce(v.capex_total, 0) AS capex_total, coalesce(v.gain_total_mw, 0) AS gain_total_mw, coalesce(v.mean_horizon, 0) AS mean_horizon, coalesce(v.mean_ease, 0) AS mean_ease, coalesce(v.mean_resilience, 0) AS mean_resilience,
         coalesce(o.relief_mw, 0) AS relief_mw, coalesce(o.intervention_cost, 0) AS intervention_cost, coalesce(o.deploy_days, 0) AS deploy_days, coalesce(o.complexity, 0) AS complexity,
         coalesce(f.flex_mw, 0) + coalesce(s.storage_mw, 0) * coalesce(s.storage_availability, 0) AS support_mw,
         (coalesce(f.flex_mw, 0) + coalesce(s.storage_mw, 0) * coalesce(s.storage_availability, 0)) / nullif(coalesce(p.peak_mw, 0), 0) AS coverage_ratio
  FROM zones z
  LEFT JOIN (SELECT zone_id, max(zone_demand_mw) AS peak_mw, avg(zone_demand_mw) AS mean_mw FROM zone_hour GROUP BY 1) p USING (zone_id)
  LEFT JOIN (SELECT s.zone_id, sum(f.capacity_mw) AS feeders_mw, sum(s.capacity_mw) AS stations_mw, sum(s.firm_mw) AS stations_firm_mw FROM substations s JOIN feeders f USING (station_id) GROUP BY 1) c USING (zone_id)
  LEFT JOIN (SELECT zone_id, sum(flex_mw) AS flex_mw, sum(cost_eur_mwh * flex_mw) / nullif(sum(flex_mw), 0) AS flex_cost, avg(availability) AS flex_availability FROM flexibility GROUP BY 1) f USING (zone_id)
  LEFT JOIN (SELECT zone_id, sum(power_mw) AS storage_mw, sum(energy_mwh) AS storage_mwh, avg(availability) AS storage_availability FROM storage GROUP BY 1) s USING (zone_id)
  LEFT JOIN (SELECT zone_id, sum(capex) AS capex_total, sum(capacity_gain) AS gain_total_mw, avg(horizon_months) AS mean_horizon, avg(ease) AS mean_ease, avg(resilience) AS mean_resilience FROM investments GROUP BY 1) v USING (zone_id)
  LEFT JOIN (SELECT zone_id, sum(relief_mw) AS relief_mw, avg(cost) AS intervention_cost, avg(days) AS deploy_days, avg(complexity) AS complexity FROM interventions GROUP BY 1) o USING (zone_id)),
node_state AS (
  SELECT n.*, f.criticality, f.growth_tension, f.flex_mw, f.storage_mw, f.storage_availability, f.support_mw, f.flex_cost,
         coalesce(e.n_events, 0) AS n_events, coalesce(e.max_rank, 0) AS max_rank, coalesce(e.event_energy_mwh, 0) AS event_energy_mwh, CAST(n.ts AS DATE) AS day,
         n.net_load_mw / nullif(n.capacity_mw, 0) AS net_load_ratio, coalesce(f.support_mw, 0) * n.demand_share AS flex_cover_mw,
         coalesce(f.storage_mw, 0) * coalesce(f.storage_availability, 0) * n.demand_share AS storage_cover_mw, n.demand_mw + n.ev_alloc_mw + n.industry_alloc_mw AS critical_mw,
         coalesce(n.load_ratio >= 0.85, FALSE) AS high_load,
         coalesce(n.load_ratio >= 1 OR n.overload_mw > 0 OR coalesce(e.n_events, 0) > 0, FALSE) AS congested,
         coalesce(n.temperature >= 33 OR n.climate_exposure >= 0.7::DOUBLE, FALSE) AS climate_stress,
         coalesce(n.voltage < 0.94::DOUBLE OR n.voltage > 1.06::DOUBLE, FALSE) AS voltage_stress,
         coalesce(n.load_ratio >= 1 OR n.overload_mw > 0 OR coalesce(e.n_events, 0) > 0 OR n.curtailment_alloc_mw > 0 OR n.voltage < 0.94::DOUBLE OR n.voltage > 1.06::DOUBLE, FALSE) AS stressed
  FROM node_load n LEFT JOIN flex_zone f USING (zone_id)
  LEFT JOIN (SELECT ts, zone_id, station_id, feeder_id, count(event_id) AS n_events, max(severity_rank) AS max_rank, sum(hour_energy_mwh) AS event_energy_mwh FROM event_hours GROUP BY 1, 2, 3, 4) e
    USING (ts, zone_id, station_id, feeder_id)),
zone_day AS (
  SELECT n.*, z.zone_name, z.region, z.zone_type, z.criticality, z.flex_potential, z.climate_risk, z.growth_tension,
         coalesce(s.n_outages, 0) AS n_outages, coalesce(s.customers, 0) AS customers, coalesce(s.ens_mwh, 0) AS ens_mwh, coalesce(s.mean_minutes, 0) AS mean_minutes, coalesce(s.overlapping_outages, 0) AS overlapping_outages
  FROM (SELECT day, zone_id, sum(demand_mw) AS demand_mwh, sum(net_load_mw) AS net_load_mwh, max(demand_mw) AS peak_mw, max(load_ratio) AS max_load_ratio, count_if(high_load) AS high_load_hours,
               count_if(congested) AS congested_hours, count_if(stressed) AS stressed_hours, sum(event_energy_mwh) AS event_energy_mwh, sum(curtailment_alloc_mw) AS curtailment_mwh,
               sum(ev_alloc_mw) AS ev_mwh, sum(industry_alloc_mw) AS industry_mwh, avg(flex_cover_mw) AS flex_cover_mw, avg(storage_cover_mw) AS storage_cover_mw,
               sum(greatest(critical_mw - flex_cover_mw, 0)) AS flex_gap_mwh, avg(flex_cost) AS flex_cost FROM node_state GROUP BY ALL) n
  JOIN zones z USING (zone_id)
  LEFT JOIN (SELECT CAST(ts_start AS DATE) AS day, zone_id, count(outage_id) AS n_outages, sum(customers) AS customers, sum(ens_mwh) AS ens_mwh, avg(minutes) AS mean_minutes, count_if(overlap_flag) AS overlapping_outages
             FROM outage_overlaps GROUP BY ALL) s USING (day, zone_id)),
zone_month AS (
  SELECT date_trunc('month', day) AS month, zone_id, max(zone_name) AS zone_name, max(zone_type) AS zone_type, max(region) AS region, max(peak_mw) AS peak_mw, sum(demand_mwh) AS demand_mwh,
         sum(net_load_mwh) AS net_load_mwh, sum(high_load_hours) AS high_load_hours, sum(congested_hours) AS congested_hours, sum(stressed_hours) AS stressed_hours, sum(event_energy_mwh) AS event_energy_mwh,
         sum(curtailment_mwh) AS curtailment_mwh, sum(ev_mwh) AS ev_mwh, sum(industry_mwh) AS industry_mwh, sum(flex_gap_mwh) AS flex_gap_mwh, sum(n_outages) AS n_outages, sum(customers) AS customers,
         sum(ens_mwh) AS ens_mwh, sum(overlapping_outages) AS overlapping_outages, avg(max_load_ratio) AS max_load_ratio, avg(flex_cover_mw) AS flex_cover_mw, avg(storage_cover_mw) AS storage_cover_mw,
         avg(flex_cost) AS flex_cost, avg(mean_minutes) AS mean_minutes, avg(criticality) AS criticality, avg(climate_risk) AS climate_risk, avg(growth_tension) AS growth_tension
  FROM zone_day GROUP BY 1, 2),
zone_risk_base AS (
  SELECT d.*, coalesce(s.mean_rank, 0) AS mean_rank, coalesce(s.max_rank, 0) AS max_rank
  FROM (SELECT zone_id, max(zone_name) AS zone_name, max(zone_type) AS zone_type, max(region) AS region, max(criticality) AS criticality, max(growth_tension) AS growth_tension, max(peak_mw) AS peak_mw,
               sum(congested_hours) AS congested_hours, sum(event_energy_mwh) AS event_energy_mwh, sum(ens_mwh) AS ens_mwh, sum(customers) AS customers, avg(max_load_ratio) AS mean_max_load,
               coalesce(avg((ev_mwh + industry_mwh) / nullif(demand_mwh, 0)), 0) AS electrification, coalesce(avg(flex_gap_mwh / nullif(demand_mwh, 0)), 0) AS flex_gap FROM zone_day GROUP BY 1) d
  LEFT JOIN (SELECT zone_id, avg(severity_rank) AS mean_rank, max(severity_rank) AS max_rank FROM ranked_events GROUP BY 1) s USING (zone_id)),
zone_risk AS (
  SELECT *, 0.24::DOUBLE * (100 * (congested_hours / nullif(max(congested_hours) OVER (), 0))) + 0.16::DOUBLE * (100 * (mean_rank / nullif(max(mean_rank) OVER (), 0)))
          + 0.18::DOUBLE * (100 * (ens_mwh / nullif(max(ens_mwh) OVER (), 0))) + 0.14::DOUBLE * (100 * (customers / nullif(max(customers) OVER (), 0)))
          + 0.10::DOUBLE * (100 * (mean_max_load / nullif(max(mean_max_load) OVER (), 0))) + 0.09::DOUBLE * (100 * criticality) + 0.09::DOUBLE * (100 * growth_tension) AS risk_score
  FROM zone_risk_base),
asset_exposure AS (
  SELECT a.*, s.zone_id, coalesce(n.hours, 0) AS hours, coalesce(n.stressed_hours, 0) AS stressed_hours, coalesce(n.congested_hours, 0) AS congested_hours, coalesce(n.mean_load, 0) AS mean_load,
         coalesce(n.max_load, 0) AS max_load, coalesce(n.event_energy_mwh, 0) AS event_energy_mwh, coalesce(o.station_ens_mwh, 0) AS station_ens_mwh, coalesce(o.station_customers, 0) AS station_customers,
         coalesce(o.station_outages, 0) AS station_outages,
         0.26::DOUBLE * (100 * (a.age_years / nullif(max(a.age_years) OVER (), 0))) + 0.18::DOUBLE * (100 * (1 - a.health)) + 0.16::DOUBLE * (100 * a.criticality)
         + 0.20::DOUBLE * (100 * (coalesce(n.stressed_hours, 0) / nullif(coalesce(n.hours, 0), 0))) + 0.20::DOUBLE * (100 * a.failure_p) AS exposure_score,
         least(1.0::DOUBLE, a.failure_p * (1 + 0.35::DOUBLE * (coalesce(n.stressed_hours, 0) / nullif(coalesce(n.hours, 0), 0)))) AS adjusted_p
  FROM assets a LEFT JOIN substations s USING (station_id)
  LEFT JOIN (SELECT station_id, feeder_id, count(*) AS hours, count_if(stressed) AS stressed_hours, count_if(congested) AS congested_hours, avg(load_ratio) AS mean_load, max(load_ratio) AS max_load,
                    sum(event_energy_mwh) AS event_energy_mwh FROM node_state GROUP BY 1, 2) n ON n.station_id = a.station_id AND n.feeder_id IS NOT DISTINCT FROM a.feeder_id
  LEFT JOIN (SELECT station_id, sum(ens_mwh) AS station_ens_mwh, sum(customers) AS station_customers, count(outage_id) AS station_outages FROM ranked_outages GROUP BY 1) o ON o.station_id = a.station_id),
flex_gap AS (
  SELECT *, greatest(critical_mw - support_mw, 0) AS gap_mw, greatest(critical_mw - support_mw, 0) * flex_cost * (stressed_total / nullif(count(*) OVER (), 0)) AS economic_gap, support_mw / nullif(critical_mw, 0) AS flex_ratio
  FROM (SELECT f.* EXCLUDE (peak_mw), coalesce(r.risk_score, 0) AS risk_score, coalesce(r.congested_hours, 0) AS congested_hours, coalesce(r.electrification, 0) AS electrification,
               coalesce(m.critical_mw, 0) AS critical_mw, coalesce(m.stressed_total, 0) AS stressed_total, coalesce(m.gap_mwh, 0) AS gap_mwh
        FROM flex_zone f LEFT JOIN zone_risk r USING (zone_id)
        LEFT JOIN (SELECT zone_id, max(peak_mw) AS critical_mw, sum(stressed_hours) AS stressed_total, avg(flex_gap_mwh) AS gap_mwh FROM zone_month GROUP BY 1) m USING (zone_id))),
candidates AS (
  SELECT *, CASE family WHEN 'refuerzo_fisico' THEN 'refuerzo' WHEN 'operacion_avanzada' THEN 'operacion' ELSE 'flexibilidad' END AS strategy,
         max(horizon_months) OVER () AS max_horizon_months, max(resilience) OVER () AS max_resilience,
         0.28::DOUBLE * (100 * risk_reduction) + 0.22::DOUBLE * (100 * (resilience / nullif(max(resilience) OVER (), 0))) + 0.18::DOUBLE * (100 * (capacity_gain / nullif(max(capacity_gain) OVER (), 0)))
         + 0.12::DOUBLE * (100 * (efficiency / nullif(max(efficiency) OVER (), 0))) + 0.10::DOUBLE * (100 * ease) + 0.10::DOUBLE * (100 * (1 - horizon_months / nullif(max(horizon_months) OVER (), 0))) AS priority_score
  FROM (SELECT i.*, z.zone_name, z.zone_type, z.region, coalesce(r.risk_score, 0) AS risk_score, coalesce(r.congested_hours, 0) AS congested_hours, coalesce(r.ens_mwh, 0) AS ens_mwh, coalesce(r.peak_mw, 0) AS peak_mw,
               coalesce(g.gap_mw, 0) AS gap_mw, coalesce(g.flex_ratio, 0) AS flex_ratio, risk_reduction * coalesce(r.risk_score, 0) AS risk_relief,
               capacity_gain * coalesce(r.peak_mw, 0) / nullif(coalesce(g.gap_mw, 0), 0) AS relative_gain, (risk_reduction * coalesce(r.risk_score, 0) + 15 * resilience) / nullif(capex, 0) AS efficiency,
               CASE WHEN investment_type IN ('nuevo_alimentador', 'refuerzo_selectivo_lineas', 'repotenciacion_subestacion') THEN 'refuerzo_fisico' WHEN investment_type = 'almacenamiento_red' THEN 'storage_distribuido'
                    WHEN investment_type IN ('automatizacion_avanzada', 'digitalizacion_protecciones') THEN 'operacion_avanzada' ELSE 'flexibilidad_operativa' END AS family
        FROM investments i LEFT JOIN zone_risk r USING (zone_id) LEFT JOIN flex_gap g USING (zone_id) LEFT JOIN zones z ON z.zone_id = i.zone_id)),
node_features AS (
  SELECT n.*, z.climate_risk, u.usual_mw, coalesce(o.outages_now, 0) AS outages_now, coalesce(a.fragility, 0) AS fragility, CASE WHEN n.load_ratio >= 1 THEN 1 ELSE 0 END AS overloaded,
         greatest(least(1 - abs(1 - n.load_ratio), 1), 0) AS nearness, stddev_samp(n.demand_mw) OVER d AS volatility, avg(n.demand_mw) OVER d AS mean_24, max(n.load_ratio) OVER w AS max_168,
         CAST(sum(CAST(n.congested AS INT)) OVER w AS BIGINT) AS congested_168, CAST(sum(CAST(n.congested AS INT)) OVER m AS BIGINT) AS congested_720,
         CAST(sum(coalesce(o.outages_now, 0)) OVER (PARTITION BY n.station_id ORDER BY n.ts, n.feeder_id ROWS 719 PRECEDING) AS BIGINT) AS outages_720,
         (n.demand_mw - coalesce(u.usual_mw, n.demand_mw)) / nullif(coalesce(u.usual_mw, n.demand_mw), 0) AS vs_usual, n.ev_alloc_mw / nullif(n.demand_mw, 0) AS ev_pressure,
         n.industry_alloc_mw / nullif(n.demand_mw, 0) AS industry_pressure, n.flex_cover_mw / nullif(n.demand_mw, 0) AS flex_coverage, n.generation_alloc_mw / nullif(n.demand_mw, 0) AS generation_share,
         n.curtailment_alloc_mw / nullif(n.generation_alloc_mw, 0) AS curtailment_ratio
  FROM node_state n LEFT JOIN zones z USING (zone_id)
  LEFT JOIN (SELECT feeder_id, station_id, zone_id, hour_of_day, day_type, avg(demand_mw) AS usual_mw FROM node_state GROUP BY ALL) u USING (feeder_id, station_id, zone_id, hour_of_day, day_type)
  LEFT JOIN (SELECT station_id, ts, count(*) AS outages_now FROM (SELECT station_id, unnest(generate_series(ts_start, ts_end, INTERVAL 1 HOUR)) AS ts FROM ranked_outages) GROUP BY 1, 2) o ON o.station_id = n.station_id AND o.ts = n.ts
  LEFT JOIN (SELECT station_id, feeder_id, avg(exposure_score) / 100 AS fragility FROM asset_exposure GROUP BY 1, 2) a ON a.station_id = n.station_id AND a.feeder_id = n.feeder_id
  WINDOW d AS (PARTITION BY n.feeder_id ORDER BY n.ts ROWS 23 PRECEDING), w AS (PARTITION BY n.feeder_id ORDER BY n.ts ROWS 167 PRECEDING), m AS (PARTITION BY n.feeder_id ORDER BY n.ts ROWS 719 PRECEDING)),
zone_day_features AS (
  SELECT z.*, coalesce(c.mean_rank, 0) AS mean_rank, coalesce(a.exposure, 0) AS exposure, quantile_cont(z.max_load_ratio, 0.95) OVER (PARTITION BY z.zone_id) AS load_p95,
         z.ens_mwh + 0.15::DOUBLE * z.curtailment_mwh AS unserved_mwh, 2500 * z.ens_mwh + 90 * z.curtailment_mwh + 45.0::DOUBLE * z.congested_hours AS risk_cost
  FROM zone_day z LEFT JOIN (SELECT zone_id, CAST(ts_start AS DATE) AS day, avg(severity_rank) AS mean_rank FROM ranked_events GROUP BY 1, 2) c USING (zone_id, day)
  LEFT JOIN (SELECT zone_id, avg(exposure_score) AS exposure FROM asset_exposure GROUP BY 1) a USING (zone_id)),
zone_month_features AS (
  SELECT *, demand_mwh - lag(demand_mwh) OVER (PARTITION BY zone_id ORDER BY month) AS trend_mwh, demand_mwh / nullif(avg(demand_mwh) OVER (PARTITION BY zone_id), 0) AS seasonal, congested_hours / 720.0::DOUBLE AS recurrence,
         0.28::DOUBLE * (100 * (congested_hours / nullif(max(congested_hours) OVER (), 0))) + 0.24::DOUBLE * (100 * (ens_mwh / nullif(max(ens_mwh) OVER (), 0)))
         + 0.20::DOUBLE * (100 * (flex_gap_mwh / nullif(max(flex_gap_mwh) OVER (), 0))) + 0.14::DOUBLE * (100 * criticality) + 0.14::DOUBLE * (100 * growth_tension) AS risk,
         100 - (0.40::DOUBLE * (100 * (ens_mwh / nullif(max(ens_mwh) OVER (), 0))) + 0.30::DOUBLE * (100 * (congested_hours / nullif(max(congested_hours) OVER (), 0))) + 0.30::DOUBLE * (100 * climate_risk)) AS resilience,
         peak_mw * 320 + flex_gap_mwh * 28 AS capex_intensity, flex_cover_mw / nullif(peak_mw, 0) AS flex_effective, storage_cover_mw / nullif(peak_mw, 0) AS storage_effective
  FROM zone_month),
candidate_features AS (
  SELECT *, CASE WHEN risk_score >= 75 THEN 'congestion_estructural' WHEN mean_exposure >= 65 THEN 'degradacion_activos' WHEN mean_gap >= 25 THEN 'brecha_flexibilidad' WHEN ev_weight >= 0.6 THEN 'presion_ev'
                 ELSE 'presion_electrificacion_industrial' END AS driver,
         0.35::DOUBLE * risk_score + 0.25::DOUBLE * month_risk + 0.20::DOUBLE * mean_exposure + 0.20::DOUBLE * mean_gap AS technical, 0.45::DOUBLE * risk_cost + 0.35::DOUBLE * capex_intensity + 0.20::DOUBLE * capex AS economic,
         0.45::DOUBLE * (100 * flex_effective) + 0.35::DOUBLE * (100 * storage_effective) + 0.20::DOUBLE * (100 * ease) AS viability,
         0.40::DOUBLE * (100 * ease) + 0.30::DOUBLE * (100 * (1 - horizon_months / nullif(max_horizon_months, 0))) + 0.30::DOUBLE * (100 * (resilience / nullif(max_resilience, 0))) AS readiness
  FROM (SELECT c.*, coalesce(d.risk_cost, 0) AS risk_cost, coalesce(d.mean_gap, 0) AS mean_gap, coalesce(d.mean_exposure, 0) AS mean_exposure, coalesce(d.ev_weight, 0) AS ev_weight, coalesce(m.month_risk, 0) AS month_risk,
               coalesce(m.capex_intensity, 0) AS capex_intensity, coalesce(m.flex_effective, 0) AS flex_effective, coalesce(m.storage_effective, 0) AS storage_effective
        FROM candidates c
        LEFT JOIN (SELECT zone_id, avg(risk_cost) AS risk_cost, avg(flex_gap_mwh) AS mean_gap, avg(exposure) AS mean_exposure, avg(ev_mwh / nullif(ev_mwh + industry_mwh + 1e-9, 0)) AS ev_weight FROM zone_day_features GROUP BY 1) d USING (zone_id)
        LEFT JOIN (SELECT zone_id, avg(risk) AS month_risk, avg(capex_intensity) AS capex_intensity, avg(flex_effective) AS flex_effective, avg(storage_effective) AS storage_effective FROM zone_month_features GROUP BY 1) m USING (zone_id)))
"""


def with_layers(body: str, more: str = "") -> str:
    """A query over the roles and layers; ``more``: further common table expressions."""
    return f"WITH {role_sql()},\n{LAYERS.strip()}{',' if more else ''}\n{more}\n{body}"
