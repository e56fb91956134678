"""SQL text over layers, the board's month and scenario filters, sessions, pivots, correlations and comparisons of outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.exprs import count_if, known, ratio, round_away
from gridloom.operators import anomalies
from gridloom.operators.diff import CHANGED, SAME, compared, correlations
from gridloom.operators.quantiles import quantiles
from gridloom.operators.ranges import islands, month
from gridloom.operators.scoring import SCENARIOS, URGENCY
from gridloom.plans import layers
from gridloom.plans.decisions import Decisions
from gridloom.plans.decisions_sql import ALL, ANOMALY
from gridloom.plans.marts_sql import rounded
from gridloom.plans.q_groups import _table
from gridloom.plans.query import NUDGE, Query

# SQL text as a user writes it

REGIONS = "SELECT region, count(*) AS n, sum(demand_mwh) AS demand_mwh, sum(ens_mwh) AS ens_mwh, max(peak_mw) AS peak_mw FROM {zone_month} WHERE zone_type <> :without GROUP BY region"
STEPS = {
    "stations_hours": "SELECT station_id, zone_id, count(*) AS hours, avg(load_ratio) AS mean_load, sum(CASE WHEN congested THEN 1 ELSE 0 END) AS congested_hours FROM {node_state} GROUP BY station_id, zone_id",
    "stations_loaded": "SELECT s.*, b.capacity_mw FROM {stations_hours} AS s JOIN {substations} AS b ON s.station_id = b.station_id WHERE congested_hours >= :least",
    "stations_result": "SELECT l.zone_id, z.zone_name, count(*) AS n_stations, sum(l.congested_hours) AS congested_hours, max(l.mean_load) AS max_mean_load, sum(l.capacity_mw) AS capacity_mw FROM {stations_loaded} AS l JOIN {zones} AS z ON l.zone_id = z.zone_id GROUP BY l.zone_id, z.zone_name",
}


def _steps_sql(least: int) -> str:
    *first, last = STEPS
    return f"WITH {', '.join(f'{k} AS ({layers.plain(STEPS[k])})' for k in first)} {layers.plain(STEPS[last])}".replace(":least", str(least))


# the board under month, zone, type and scenario at once

FACTORS = ("load", "congestion", "ens", "curtailment", "flex_gap", "cost", "investment", "priority")
COST = {"ens_mwh": 2500.0, "curtailment_mwh": 90.0, "congested_hours": 45.0}  # fixed values: cost of a unit


def board(m: Decisions, first: str | None = None, last: str | None = None, region: str | None = None, zone_type: str | None = None, zone: object = None, asset_type: str | None = None, scenario: str | None = None) -> DataFrame:
    """One row of the board's figures over the months ``first`` to ``last`` (``yyyy-MM``) and the zones and feeders that fit, under a scenario's factors.

    It is added up from ``month_measures``; the feeder-hours aren't read again.
    Outages belong to zones, so a filter on the type of assets leaves them whole.
    """
    m.keep("month_measures")
    rows = m.month_measures.join(m.frame("zones").select("zone_id", "region", "zone_type"), "zone_id")
    rows = rows.where("whole = 1") if asset_type is None else rows.where((F.col("whole") == 0) & (F.col("asset_type") == asset_type))
    at = F.date_format("month", "yyyy-MM")
    for fits, value in ((at >= F.lit(first), first), (at <= F.lit(last), last), (F.col("region") == F.lit(region), region), (F.col("zone_type") == F.lit(zone_type), zone_type), (F.col("zone_id") == F.lit(zone), zone)):
        if value is not None:
            rows = rows.where(fits)
    by = dict(zip(FACTORS, SCENARIOS[scenario], strict=True)) if scenario else dict.fromkeys(FACTORS, 1.0)
    one = rows.agg(
        F.countDistinct("zone_id").alias("n_zones"), F.countDistinct("month").alias("n_months"), known(F.sum("hours"), 0).alias("hours"), known(F.sum("demand_mwh")).alias("demand_mwh"),
        (known(ratio(F.sum("load_sum"), F.sum("hours"))) * by["load"]).alias("mean_load"), (known(F.max("peak_mw")) * by["load"]).alias("peak_mw"), (known(F.sum("congested_hours"), 0) * by["congestion"]).alias("congested_hours"),
        (known(F.sum("ens_mwh")) * by["ens"]).alias("ens_mwh"), known(F.sum("customers"), 0).alias("customers"), known(F.sum("n_outages"), 0).alias("n_outages"), known(ratio(F.sum("minutes"), F.sum("n_outages"))).alias("mean_minutes"),
        (known(F.sum("curtailment_mwh")) * by["curtailment"]).alias("curtailment_mwh"), (known(F.sum("flex_gap_mwh")) * by["flex_gap"]).alias("flex_gap_mwh"), known(ratio(F.sum("new_mwh"), F.sum("demand_mwh"))).alias("new_ratio"))
    return one.withColumn("risk_cost", sum((F.col(c) * w for c, w in COST.items()), F.lit(0.0)))


def _board_sql(where: str, kind: str | None, scenario: str | None) -> str:
    f = dict(zip(FACTORS, (f"{x!r}::DOUBLE" for x in (SCENARIOS[scenario] if scenario else [1.0] * 8)), strict=True))
    typed = f"JOIN (SELECT feeder_id, max(asset_type) AS asset_type FROM asset_exposure WHERE feeder_id IS NOT NULL GROUP BY 1) k ON k.feeder_id = n.feeder_id AND k.asset_type = '{kind}'" if kind else ""
    cost = " + ".join(f"{w!r}::DOUBLE * {c}" for c, w in COST.items())
    return f"""SELECT *, {cost} AS risk_cost FROM (SELECT count(DISTINCT a.zone_id) AS n_zones, count(DISTINCT a.month) AS n_months, coalesce(sum(hours), 0) AS hours, coalesce(sum(demand_mwh), 0) AS demand_mwh, coalesce(sum(load_sum) / nullif(sum(hours), 0), 0) * {f["load"]} AS mean_load,
  coalesce(max(peak_mw), 0) * {f["load"]} AS peak_mw, coalesce(sum(congested_hours), 0) * {f["congestion"]} AS congested_hours, coalesce(sum(ens_mwh), 0) * {f["ens"]} AS ens_mwh, coalesce(sum(customers), 0) AS customers, coalesce(sum(n_outages), 0) AS n_outages,
  coalesce(sum(minutes) / nullif(sum(n_outages), 0), 0) AS mean_minutes, coalesce(sum(curtailment_mwh), 0) * {f["curtailment"]} AS curtailment_mwh, coalesce(sum(flex_gap_mwh), 0) * {f["flex_gap"]} AS flex_gap_mwh, coalesce(sum(new_mwh) / nullif(sum(demand_mwh), 0), 0) AS new_ratio
FROM (SELECT date_trunc('month', n.day) AS month, n.zone_id, count(*) AS hours, count_if(congested) AS congested_hours, sum(demand_mw) AS demand_mwh, sum(load_ratio) AS load_sum, sum(curtailment_alloc_mw) AS curtailment_mwh, sum(ev_alloc_mw + industry_alloc_mw) AS new_mwh,
        sum(greatest(critical_mw - flex_cover_mw, 0)) AS flex_gap_mwh, max(demand_mw) AS peak_mw FROM node_state n {typed} GROUP BY 1, 2) a JOIN zones z ON z.zone_id = a.zone_id
LEFT JOIN (SELECT date_trunc('month', ts_start) AS month, zone_id, count(*) AS n_outages, sum(customers) AS customers, sum(ens_mwh) AS ens_mwh, sum(minutes) AS minutes FROM outage_overlaps GROUP BY 1, 2) o ON o.month = a.month AND o.zone_id = a.zone_id WHERE {where})"""


BOARD = "#n_zones #n_months #hours ~demand_mwh:2 ~mean_load ~peak_mw ~congested_hours ~ens_mwh ~customers ~n_outages ~mean_minutes ~curtailment_mwh ~flex_gap_mwh:2 ~new_ratio ~risk_cost:2"

# sessions of congestion

LADDER = (("critica", 1.28, 6), ("alta", 1.15, 3), ("media", 1.05, None))  # fixed values: load and hours of each severity
SERVICE = 0.82  # fixed value: share of sessions below whose energy service isn't touched


def sessions(m: Decisions) -> DataFrame:
    """Runs of congested hours of a feeder, an hour apart at most, with all that a congestion event tells.

    Runs are found in months and merged across their borders, so a feeder's
    history is in no one task.
    """
    over = F.greatest(F.col("demand_mw") - F.col("capacity_mw"), F.lit(0.0)) + F.lit(0.28) * F.greatest(F.col("demand_mw") - F.lit(0.95) * F.col("capacity_mw"), F.lit(0.0))
    hours = m.node_state.where("congested").select("feeder_id", "ts", "zone_id", "station_id", "grid_type", "hour_of_day", "load_ratio", over.alias("over_mw"))
    runs = islands(hours, ["feeder_id"], month("ts"), "ts", 3600)
    first = lambda c: F.min_by(c, "ts").alias(c)
    s = runs.groupBy("feeder_id", "island").agg(
        F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), first("zone_id"), first("station_id"), first("grid_type"), F.max("load_ratio").alias("max_load"),
        round_away(F.sum("over_mw"), 5, NUDGE).alias("energy_mwh"), F.avg("hour_of_day").alias("mean_hour"), F.count(F.lit(1)).alias("hours"))
    s = s.withColumn("duration_h", (F.unix_timestamp("ts_end") - F.unix_timestamp("ts_start")) / 3600 + 1)
    severity = F.lit("baja")
    for name, load, long in reversed(LADDER):
        severity = F.when((F.col("max_load") >= load) | (F.col("duration_h") >= long if long else F.lit(False)), name).otherwise(severity)
    cause = F.when(F.col("mean_hour").between(18, 23), "pico_ev_residencial").when(F.col("grid_type").isin("industrial_dedicada", "aerea_reforzada"), "electrificacion_industrial").when(F.col("max_load") > 1.24, "capacidad_termica_insuficiente")
    s = m.once(s.withColumns({"severity": severity, "cause": cause}), "sessions")
    limit = quantiles(s.select(F.lit(1).alias("all"), "energy_mwh"), ["all"], "energy_mwh", {"limit": SERVICE}, m.once).select("limit")
    return s.crossJoin(F.broadcast(limit)).withColumn("service_flag", F.col("severity").isin("alta", "critica") | (F.col("energy_mwh") > F.col("limit")))  # one row


_over = "greatest(demand_mw - capacity_mw, 0) + 0.28::DOUBLE * greatest(demand_mw - 0.95::DOUBLE * capacity_mw, 0)"
_cases = " ".join(f"WHEN max_load >= {load}::DOUBLE{f' OR duration_h >= {long}' if long else ''} THEN '{name}'" for name, load, long in LADDER)
SESSIONS = f"""SELECT *, severity IN ('alta', 'critica') OR energy_mwh > quantile_cont(energy_mwh, {SERVICE}) OVER () AS service_flag FROM (SELECT *, CASE {_cases} ELSE 'baja' END AS severity,
  CASE WHEN mean_hour BETWEEN 18 AND 23 THEN 'pico_ev_residencial' WHEN grid_type IN ('industrial_dedicada', 'aerea_reforzada') THEN 'electrificacion_industrial' WHEN max_load > 1.24::DOUBLE THEN 'capacidad_termica_insuficiente' END AS cause
FROM (SELECT feeder_id, island, min(ts) AS ts_start, max(ts) AS ts_end, arg_min(zone_id, ts) AS zone_id, arg_min(station_id, ts) AS station_id, arg_min(grid_type, ts) AS grid_type, max(load_ratio) AS max_load, {rounded("sum(over_mw)", 5, NUDGE)} AS energy_mwh, avg(hour_of_day) AS mean_hour,
        count(*) AS hours, date_diff('second', min(ts), max(ts)) / 3600 + 1 AS duration_h
      FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY feeder_id ORDER BY ts) AS island
            FROM (SELECT feeder_id, ts, zone_id, station_id, grid_type, hour_of_day, load_ratio, {_over} AS over_mw, lag(ts) OVER (PARTITION BY feeder_id ORDER BY ts) AS before FROM node_state WHERE congested)) GROUP BY 1, 2))"""

# pivots, scatter data, correlations, differences

TYPES = tuple(anomalies.ADVICE)
MEASURED = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "nullif(l_discount, 0)", "tax": "nullif(l_tax, 0)", "line": "l_linenumber"}


def _scatter(m: Decisions) -> DataFrame:
    """The points of the five scatter charts: chart, zone, x, y."""
    m.keep("zone_day", "flex_gap", "ranking")
    days = m.zone_day_features.groupBy("zone_id").agg(F.sum("ev_mwh").alias("ev"), F.avg("load_p95").alias("p95"), F.sum("industry_mwh").alias("industry"), F.sum("congested_hours").alias("congested"))
    point = lambda df, chart, x, y: df.select(F.lit(chart).alias("chart"), "zone_id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    parts = [point(m.flex_gap, "flexibility", "support_mw", "critical_mw"), point(m.flex_gap, "storage", "storage_mw", "risk_score"), point(days, "ev", "ev", "p95"), point(days, "industry", "industry", "congested"), point(m.ranking, "scores", "congestion_risk_score", "economic_priority_score")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _shifted(m: Decisions) -> DataFrame:
    """How the order of zones under other weights compares with the written ranking: zones by status and factor."""
    m.keep("ranking_table", "sensitivity")
    factors = m.sensitivity.select("factor").distinct()
    own = m.ranking_table.select("zone_id", "rank").crossJoin(F.broadcast(factors))  # two factors
    return compared(own, m.sensitivity.select("factor", "zone_id", "rank"), ["factor", "zone_id"]).groupBy("factor", "status").agg(F.count(F.lit(1)).alias("n"))


_moved = list(URGENCY)[:2]
_alternative = " + ".join(f"{w!r}::DOUBLE * {'factor * ' if s in _moved else ''}{s}" for s, w in URGENCY.items())
_sensitivity = f"SELECT *, row_number() OVER (PARTITION BY factor ORDER BY alternative DESC, zone_id) AS rank FROM (SELECT s.zone_id, f.factor, {_alternative} AS alternative FROM scores s CROSS JOIN (VALUES (0.9::DOUBLE), (1.1::DOUBLE)) f(factor))"

QUERIES = [
    Query("sql_layer_regions", "region #n ~demand_mwh:2 ~ens_mwh ~peak_mw", lambda m: layers.sql(m, REGIONS, without="rural"), layers.plain(REGIONS).replace(":without", "'rural'")),
    Query("sql_layer_steps", "zone_id zone_name #n_stations #congested_hours ~max_mean_load ~capacity_mw", lambda m: layers.run(m, STEPS, least=2)["stations_result"], _steps_sql(2)),
    Query("dash_month_scenario", BOARD, lambda m: board(m, "2024-01", "2024-01", region="ASIA", asset_type="MACHINERY", scenario="retraso_capex"), _board_sql("region = 'ASIA' AND strftime(a.month, '%Y-%m') BETWEEN '2024-01' AND '2024-01'", "MACHINERY", "retraso_capex")),
    Query("dash_scenario_type", BOARD, lambda m: board(m, zone_type="rural", scenario="capex_mas_flexibilidad"), _board_sql("zone_type = 'rural'", None, "capex_mas_flexibilidad")),
    Query("session_events", "feeder_id #island ^ts_start ^ts_end zone_id station_id grid_type ~max_load ~energy_mwh:3 ~mean_hour #hours ~duration_h severity cause service_flag", sessions, SESSIONS),
    Query("pivot_sensitivity", "zone_id ~low ~high", lambda m: m.sensitivity.groupBy("zone_id").pivot("factor", [0.9, 1.1]).agg(F.avg("rank")).toDF("zone_id", "low", "high"),
          "SELECT zone_id, avg(rank) FILTER (factor = 0.9::DOUBLE) AS low, avg(rank) FILTER (factor = 1.1::DOUBLE) AS high FROM (" + _sensitivity + ") GROUP BY 1", more=ALL),
    Query("pivot_day_anomalies", "@day " + " ".join(f"#{t}" for t in TYPES), lambda m: m.anomalies.groupBy("day").agg(*(count_if(F.col("anomaly_type") == t).alias(t) for t in TYPES)), "SELECT day, " + ", ".join(f"count_if(anomaly_type = '{t}') AS {t}" for t in TYPES) + " FROM anomalies GROUP BY 1", more=ANOMALY),
    Query("chart_scatter", "chart zone_id ~x ~y", _scatter,
          "SELECT 'flexibility' AS chart, zone_id, support_mw::DOUBLE AS x, critical_mw::DOUBLE AS y FROM flex_gap UNION ALL SELECT 'storage', zone_id, storage_mw, risk_score FROM flex_gap UNION ALL SELECT 'ev', zone_id, sum(ev_mwh), avg(load_p95) FROM zone_day_features GROUP BY 2 "
          "UNION ALL SELECT 'industry', zone_id, sum(industry_mwh), sum(congested_hours) FROM zone_day_features GROUP BY 2 UNION ALL SELECT 'scores', zone_id, congestion_risk_score, economic_priority_score FROM ranking", more=ALL),
    _table("agg_corr_matrix", "a b #n ~r", lambda m: correlations(m.table("lineitem").select(*(F.expr(x).alias(k) for k, x in MEASURED.items())), list(MEASURED)),
           " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count_if({x} IS NOT NULL AND {y} IS NOT NULL) AS n, corr({x}::DOUBLE, {y}::DOUBLE) AS r FROM lineitem" for a, x in MEASURED.items() for b, y in MEASURED.items())),
    Query("dq_rank_diff", "~factor status #n", _shifted,
          "SELECT factor, CASE WHEN s.rank = r.rank THEN '" + SAME + "' ELSE '" + CHANGED + "' END AS status, count(*) AS n FROM (" + _sensitivity + ") s JOIN (SELECT zone_id, row_number() OVER (ORDER BY round(priority, 6) DESC, zone_id) AS rank FROM ranking) r USING (zone_id) GROUP BY 1, 2", more=ALL),
]
