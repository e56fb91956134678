"""Queries of the decision board: profiles, scalars, targets, filters, drill-downs, charts and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import boundaries, count_if, known, ratio, round_away, weighted
from gridloom.operators.scales import min_max
from gridloom.operators.scoring import SCORES
from gridloom.plans.decisions import Decisions
from gridloom.plans.decisions_sql import ALL
from gridloom.plans.q_groups import _mm_sql
from gridloom.plans.q_kpi import DEFERRABLE, NEW_DEMAND, _deferrable, _new_demand
from gridloom.plans.query import NUDGE, Query

# Targets of the board's figures, and whether a figure should stay at most or reach at least its target.
TARGETS = {
    "mean_load": (0.95, "at most"),
    "critical_pct": (10.0, "at most"),
    "flex_ratio": (0.85, "at least"),
    "saidi": (120.0, "at most"),
    "deferrable_pct": (12.0, "at least"),
    "new_ratio": (0.08, "at most"),
}
# Part of a target within which a missed figure is watched, its three states, and the score of a critical zone.
BAND = 0.2
LIGHTS = ("OK", "Vigilancia", "Crítico")
CRITICAL = 75
# Weights of a feeder's criticality.
FEEDER = {"mean_p_mm": 0.45, "ens_mwh_mm": 0.35, "mean_exposure_mm": 0.20}
#: Of how many leading entities a chart shows.
SHOWN = 12


def feeders(m: Decisions) -> DataFrame:
    """Assets of each feeder: their type (the last by name), number, failure, unserved energy and size of exposure."""
    a = m.asset_exposure.where("feeder_id IS NOT NULL")
    return a.groupBy("zone_id", "station_id", "feeder_id").agg(
        F.max("asset_type").alias("asset_type"), F.count(F.lit(1)).alias("n_assets"), F.avg(F.abs("exposure_score")).alias("mean_exposure"), F.avg("adjusted_p").alias("mean_p"), F.sum("station_ens_mwh").alias("ens_mwh"))


FEEDERS = "SELECT zone_id, station_id, feeder_id, max(asset_type) AS asset_type, count(*) AS n_assets, avg(abs(exposure_score)) AS mean_exposure, avg(adjusted_p) AS mean_p, sum(station_ens_mwh) AS ens_mwh FROM asset_exposure WHERE feeder_id IS NOT NULL GROUP BY 1, 2, 3"


def feeder_rank(m: Decisions) -> DataFrame:
    return min_max(m.once(feeders(m), "feeder_base"), [c.removesuffix("_mm") for c in FEEDER]).withColumn("criticality", weighted(FEEDER))


FEEDER_RANK = f"SELECT *, {' + '.join(f'{w}::DOUBLE * ({_mm_sql(c.removesuffix("_mm"))})' for c, w in FEEDER.items())} AS criticality FROM ({FEEDERS})"


def interruptions(m: Decisions) -> DataFrame:
    """Outages of each zone; minutes count the boundaries crossed."""
    return m.frame("outages").groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("n_outages"), F.sum("customers").alias("customers"), F.sum("ens_mwh").alias("ens_mwh"), F.avg(boundaries("minute", "ts_start", "ts_end")).alias("mean_minutes"), F.avg(F.when(F.col("congestion_flag"), 1).otherwise(0)).alias("congestion_share"))


INTERRUPTIONS = "SELECT zone_id, count(*) AS n_outages, sum(customers) AS customers, sum(ens_mwh) AS ens_mwh, avg(date_diff('minute', ts_start, ts_end)) AS mean_minutes, avg(CASE WHEN congestion_flag THEN 1 ELSE 0 END) AS congestion_share FROM outages GROUP BY 1"

SCORED = ("priority", "tier", "urgency_tier", "driver", "intervention", "sequence", "confidence", "decision", *SCORES, "capex_total", "risk_cost", "mean_horizon")


def profile(m: Decisions) -> DataFrame:
    """Zones with their risk, scores, outages and new demand; figures that a zone lacks are 0."""
    m.keep("zone_risk", "ranking", "zone_month")
    outages = interruptions(m).select("zone_id", "n_outages", "mean_minutes", "congestion_share", F.col("customers").alias("outage_customers"))
    new = _new_demand(m).select("zone_id", "ev_mwh", "industry_mwh", "new_mwh", "new_ratio")
    out = m.zone_risk
    for part in (m.ranking.select("zone_id", *SCORED), outages, new):
        out = out.join(part, "zone_id", "left")
    return out.fillna(0)


_zeros = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("priority", *SCORES, "capex_total", "risk_cost", "mean_horizon"))
PROFILE = (f"SELECT r.*, {_zeros}, k.tier, k.urgency_tier, k.driver, k.intervention, k.sequence, k.confidence, k.decision, coalesce(i.n_outages, 0) AS n_outages, coalesce(i.mean_minutes, 0) AS mean_minutes, coalesce(i.congestion_share, 0) AS congestion_share, "
           f"coalesce(i.customers, 0) AS outage_customers, coalesce(n.ev_mwh, 0) AS ev_mwh, coalesce(n.industry_mwh, 0) AS industry_mwh, coalesce(n.new_mwh, 0) AS new_mwh, coalesce(n.new_ratio, 0) AS new_ratio "
           f"FROM zone_risk r LEFT JOIN ranking k USING (zone_id) LEFT JOIN ({INTERRUPTIONS}) i USING (zone_id) LEFT JOIN ({NEW_DEMAND}) n USING (zone_id)")

DEFERRED = "contains(lower(decision), 'diferir') AND tier IN ('bajo', 'medio')"


def filtered(m: Decisions, zone: int | None = None, station: int | None = None, region: str | None = None, zone_type: str | None = None, tier: str | None = None, intervention: str | None = None, asset_type: str | None = None) -> DataFrame:
    """The zones that fit every filter given: their own columns, and semi-joins for a substation or the type of a feeder's assets."""
    out = profile(m)
    for name, value in (("zone_id", zone), ("region", region), ("zone_type", zone_type), ("tier", tier), ("intervention", intervention)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if station is not None:
        out = out.join(m.frame("substations").where(F.col("station_id") == station).select("zone_id"), "zone_id", "left_semi")
    if asset_type is not None:
        out = out.join(feeders(m).where(F.col("asset_type") == asset_type).select("zone_id"), "zone_id", "left_semi")
    return out


def figures(m: Decisions, zones: DataFrame) -> DataFrame:
    """One row of the board's figures over ``zones`` (rows of ``profile``)."""
    z = zones.join(_deferrable(m).select("zone_id", "deferrable_capex"), "zone_id", "left").join(m.flex_gap.select("zone_id", "gap_mw", "flex_ratio"), "zone_id", "left")
    share = lambda c: F.lit(100.0) * ratio(count_if(c), F.greatest(F.count(F.lit(1)), F.lit(1)))
    deferred = F.lower("decision").contains("diferir") & F.col("tier").isin("bajo", "medio")
    told = F.col("n_outages") > 0  # zones without outages have no mean length
    one = z.agg(
        F.count(F.lit(1)).alias("n_zones"), known(F.sum("congested_hours"), 0).alias("congested_hours"), known(count_if(F.col("risk_score") >= CRITICAL), 0).alias("critical_zones"), known(share(F.col("risk_score") >= CRITICAL)).alias("critical_pct"),
        known(F.sum("ens_mwh")).alias("ens_mwh"), known(F.sum("customers"), 0).alias("customers"), known(F.avg("mean_max_load")).alias("mean_load"), known(share(F.col("mean_max_load") > 1)).alias("overloaded_pct"),
        known(F.sum("risk_cost")).alias("risk_cost"), known(F.sum("capex_total")).alias("capex_total"), known(F.sum("deferrable_capex")).alias("deferrable_capex"), known(F.avg(F.when(told, F.col("mean_minutes")))).alias("saidi"),
        known(F.sum("n_outages"), 0).alias("n_outages"), (F.lit(100.0) - F.avg("resilience_risk_score")).alias("resilience"), known(count_if(deferred), 0).alias("deferrable_decisions"),
        known(F.sum("new_mwh")).alias("new_mwh"), known(F.avg("new_ratio")).alias("new_ratio"), known(F.avg("gap_mw")).alias("mean_gap_mw"), known(F.avg("flex_ratio")).alias("flex_ratio"))
    return one.withColumns({"deferrable_pct": F.lit(100.0) * F.col("deferrable_capex") / F.greatest(F.col("capex_total"), F.lit(1.0)), "saifi": known(F.lit(1000.0) * ratio("n_outages", "customers")), "resilience": known("resilience")})


def figures_sql(zones: str) -> str:
    return ("SELECT *, 100.0::DOUBLE * deferrable_capex / greatest(capex_total, 1) AS deferrable_pct, coalesce(1000.0::DOUBLE * n_outages / nullif(customers, 0), 0) AS saifi FROM ("
            f"SELECT count(*) AS n_zones, coalesce(sum(congested_hours), 0) AS congested_hours, count_if(risk_score >= {CRITICAL}) AS critical_zones, 100.0::DOUBLE * count_if(risk_score >= {CRITICAL}) / greatest(count(*), 1) AS critical_pct, "
            "coalesce(sum(ens_mwh), 0) AS ens_mwh, coalesce(sum(customers), 0) AS customers, coalesce(avg(mean_max_load), 0) AS mean_load, 100.0::DOUBLE * count_if(mean_max_load > 1) / greatest(count(*), 1) AS overloaded_pct, "
            "coalesce(sum(risk_cost), 0) AS risk_cost, coalesce(sum(capex_total), 0) AS capex_total, coalesce(sum(deferrable_capex), 0) AS deferrable_capex, coalesce(avg(CASE WHEN n_outages > 0 THEN mean_minutes END), 0) AS saidi, "
            f"coalesce(sum(n_outages), 0) AS n_outages, coalesce(100 - avg(resilience_risk_score), 0) AS resilience, count_if({DEFERRED}) AS deferrable_decisions, "
            "coalesce(sum(new_mwh), 0) AS new_mwh, coalesce(avg(new_ratio), 0) AS new_ratio, coalesce(avg(gap_mw), 0) AS mean_gap_mw, coalesce(avg(flex_ratio), 0) AS flex_ratio "
            f"FROM ({zones}) z LEFT JOIN (SELECT zone_id, deferrable_capex FROM ({DEFERRABLE})) d USING (zone_id) LEFT JOIN (SELECT zone_id, gap_mw, flex_ratio FROM flex_gap) g USING (zone_id))")


def scalars(m: Decisions) -> DataFrame:
    """The official figures of all zones, with what the cheapest scenario would save."""
    m.keep("scenario_summary")
    least = m.scenario_summary.agg(F.min("cost").alias("least_cost"))
    return figures(m, profile(m)).crossJoin(F.broadcast(least)).withColumn("savings", F.greatest(F.col("risk_cost") - F.col("least_cost"), F.lit(0.0)))  # one row each


SCALARS = f"SELECT *, greatest(risk_cost - (SELECT min(cost) FROM scenario_summary), 0) AS savings FROM ({figures_sql(PROFILE)})"
SCALAR_COLUMNS = "#congested_hours #critical_zones ~critical_pct ~ens_mwh:2 #customers ~mean_load ~overloaded_pct ~risk_cost:2 ~capex_total:2 ~deferrable_capex:2 ~deferrable_pct ~savings:2 ~saidi ~saifi ~resilience:3 #deferrable_decisions"


def light(value: Column, target: Column, rule: Column) -> Column:
    """Whether a figure meets its target, misses it within the band, or by more."""
    ok = F.when(rule == "at most", value <= target).otherwise(value >= target)
    near = F.when(rule == "at most", value <= target * F.lit(1 + BAND)).otherwise(value >= target * F.lit(1 - BAND))
    return F.when(ok, LIGHTS[0]).when(near, LIGHTS[1]).otherwise(LIGHTS[2])


def benchmarks(m: Decisions) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("value"), F.lit(t).alias("target"), F.lit(rule).alias("rule")) for k, (t, rule) in TARGETS.items())))
    return figures(m, profile(m)).select(rows.alias("k")).select("k.*").withColumn("light", light(F.col("value"), F.col("target"), F.col("rule")))


BENCHMARKS = (f"SELECT *, CASE WHEN (rule = 'at most' AND value <= target) OR (rule = 'at least' AND value >= target) THEN '{LIGHTS[0]}' WHEN (rule = 'at most' AND value <= target * {1 + BAND}::DOUBLE) OR (rule = 'at least' AND value >= target * {1 - BAND}::DOUBLE) THEN '{LIGHTS[1]}' ELSE '{LIGHTS[2]}' END AS light FROM ("
              + " UNION ALL ".join(f"SELECT '{k}' AS kpi, {k} AS value, {t}::DOUBLE AS target, '{rule}' AS rule FROM board" for k, (t, rule) in TARGETS.items()) + ")")


def drill_down(m: Decisions, zone: int | None = None) -> DataFrame:
    """The given zone, or the one of highest priority, with its options from the best on."""
    zones = profile(m)
    first = (zones.where(F.col("zone_id") == zone) if zone is not None else zones).orderBy(round_away("priority", 6).desc(), "zone_id").limit(1)
    opts = m.options.select("zone_id", "option", "option_score", "impact", "cost")
    place = F.row_number().over(Window.partitionBy("zone_id").orderBy(round_away("option_score", 6).desc(), "option"))
    return first.join(opts, "zone_id", "left").withColumn("place", place)


def decisions(m: Decisions) -> DataFrame:
    """The decision list's figures in one row: leading zones, cases by kind of intervention, mean score and capital."""
    r = m.ranking.select("zone_id", "priority", "intervention", "capex_total")
    of = lambda *kinds: count_if(F.col("intervention").isin(*kinds))
    counts = r.agg(of("reforzar_red_local").alias("reinforce"), of("activar_flexibilidad", "optimizar_operacion").alias("flexible"), of("desplegar_almacenamiento").alias("storage"), of("monitorizar").alias("monitor"), F.avg("priority").alias("mean_priority"), F.sum("capex_total").alias("capex"))
    top = r.orderBy(round_away("priority", 6).desc(), "zone_id").limit(5).agg(F.array_sort(F.collect_list(F.struct((-round_away("priority", 6)).alias("p"), "zone_id"))).alias("z"))
    return counts.crossJoin(F.broadcast(top.select(F.array_join(F.transform("z", lambda x: x["zone_id"].cast("string")), ", ").alias("leaders"))))


def _charted(m: Decisions) -> list[tuple[str, DataFrame, str, str]]:
    """Chart, its rows, the entity and the value of each bar."""
    m.keep("zone_day", "zone_risk", "flex_gap", "ranking", "scenario_summary")
    n, z = m.node_state, m.zone_day
    by = lambda df, key, name, value: df.groupBy(F.col(key).cast("string").alias("entity")).agg(value.cast("double").alias(name))
    return [
        ("load_by_month", n.groupBy(F.date_format("ts", "yyyy-MM").alias("entity")).agg(F.avg("load_ratio").alias("v")), "entity", "v"),
        ("congestion_by_zone", by(z, "zone_id", "v", F.sum("congested_hours")), "entity", "v"),
        ("congestion_by_station", by(n, "station_id", "v", count_if(F.col("congested"))), "entity", "v"),
        ("stress_by_feeder", by(n, "feeder_id", "v", count_if(F.col("stressed"))), "entity", "v"),
        ("ens_by_zone", by(z, "zone_id", "v", F.sum("ens_mwh")), "entity", "v"),
        ("curtailment_by_zone", by(z, "zone_id", "v", F.sum("curtailment_mwh")), "entity", "v"),
        ("ev_by_zone", by(z, "zone_id", "v", F.sum("ev_mwh")), "entity", "v"),
        ("industry_by_zone", by(z, "zone_id", "v", F.sum("industry_mwh")), "entity", "v"),
        ("flexibility_by_zone", m.flex_gap.withColumn("v", F.col("support_mw")), "zone_id", "v"),
        ("critical_demand_by_zone", m.flex_gap, "zone_id", "critical_mw"),
        ("storage_by_zone", m.flex_gap, "zone_id", "storage_mw"),
        ("gap_by_zone", m.flex_gap, "zone_id", "gap_mw"),
        ("risk_by_zone", m.zone_risk, "zone_id", "risk_score"),
        ("priority_by_zone", m.ranking, "zone_id", "priority"),
        ("economic_by_zone", m.ranking, "zone_id", "economic_priority_score"),
        ("cost_by_scenario", m.scenario_summary, "scenario", "cost"),
        ("investment_by_scenario", m.scenario_summary, "scenario", "investment"),
    ]


def charts(m: Decisions, shown: int = SHOWN) -> DataFrame:
    """The bars of every chart, the largest ``shown`` of each, as one long table."""
    parts = [df.select(F.lit(name).alias("chart"), F.col(entity).cast("string").alias("entity"), F.col(value).cast("double").alias("value")) for name, df, entity, value in _charted(m)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    place = F.row_number().over(Window.partitionBy("chart").orderBy(round_away("value", 4, NUDGE).desc_nulls_last(), "entity"))
    return out.withColumn("place", place).where(F.col("place") <= shown)


_bars = {
    "load_by_month": "SELECT strftime(ts, '%Y-%m') AS entity, avg(load_ratio) AS value FROM node_state GROUP BY 1",
    "congestion_by_zone": "SELECT CAST(zone_id AS VARCHAR), sum(congested_hours) FROM zone_day GROUP BY 1",
    "congestion_by_station": "SELECT CAST(station_id AS VARCHAR), count_if(congested) FROM node_state GROUP BY 1",
    "stress_by_feeder": "SELECT CAST(feeder_id AS VARCHAR), count_if(stressed) FROM node_state GROUP BY 1",
    **{f"{n}_by_zone": f"SELECT CAST(zone_id AS VARCHAR), sum({c}) FROM zone_day GROUP BY 1" for n, c in (("ens", "ens_mwh"), ("curtailment", "curtailment_mwh"), ("ev", "ev_mwh"), ("industry", "industry_mwh"))},
    **{f"{n}_by_zone": f"SELECT CAST(zone_id AS VARCHAR), {c} FROM flex_gap" for n, c in (("flexibility", "support_mw"), ("critical_demand", "critical_mw"), ("storage", "storage_mw"), ("gap", "gap_mw"))},
    "risk_by_zone": "SELECT CAST(zone_id AS VARCHAR), risk_score FROM zone_risk",
    "priority_by_zone": "SELECT CAST(zone_id AS VARCHAR), priority FROM ranking",
    "economic_by_zone": "SELECT CAST(zone_id AS VARCHAR), economic_priority_score FROM ranking",
    "cost_by_scenario": "SELECT scenario, cost FROM scenario_summary",
    "investment_by_scenario": "SELECT scenario, investment FROM scenario_summary",
}


def _charts_sql() -> str:
    from gridloom.plans.marts_sql import rounded

    rows = " UNION ALL ".join(f"SELECT '{n}' AS chart, b.entity, CAST(b.value AS DOUBLE) AS value FROM ({q}) AS b(entity, value)" for n, q in _bars.items())
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY {rounded('value', 4, NUDGE)} DESC NULLS LAST, entity) AS place FROM ({rows})) WHERE place <= {SHOWN}"


def heat(m: Decisions) -> DataFrame:
    """Congestion and stress of each zone by hour of the day; stress weighs load and congestion."""
    n = m.node_state.groupBy("zone_id", "hour_of_day").agg(count_if(F.col("congested")).alias("congested_hours"), F.avg("load_ratio").alias("mean_load"), F.avg(F.col("congested").cast("int")).alias("share"))
    return n.withColumn("stress", weighted([(0.65, F.col("mean_load") / F.lit(1.2)), (0.35, "share")]))


def findings(m: Decisions) -> DataFrame:
    """The five findings' evidence: entity and figure of each."""
    m.keep("zone_day", "flex_gap", "ranking")
    first = lambda df, key, value, name: df.orderBy(round_away(F.col(value).cast("double"), 4, NUDGE).desc_nulls_last(), key).limit(1).select(F.lit(name).alias("finding"), F.col(key).cast("string").alias("entity"), F.col(value).cast("double").alias("value"))
    nodes = m.node_state.groupBy("zone_id", "station_id", "feeder_id").agg(count_if(F.col("congested")).alias("h")).orderBy(F.desc("h"), "feeder_id").limit(10).agg(F.sum("h").cast("double").alias("value"))
    ens = m.zone_day.groupBy("zone_id").agg(F.sum("ens_mwh").alias("v"))
    new = m.zone_day.groupBy("zone_id").agg((F.sum("ev_mwh") + F.sum("industry_mwh")).alias("n")).withColumn("v", F.col("n") / (F.col("n") + F.lit(1.0)))
    kinds = m.ranking.groupBy("intervention").agg(F.count(F.lit(1)).alias("v"))
    out = nodes.select(F.lit("1 congestion of the ten leading nodes").alias("finding"), F.lit("nodes").alias("entity"), "value")
    for p in (first(ens, "zone_id", "v", "2 leading zone in unserved energy"), first(m.flex_gap, "zone_id", "gap_mw", "3 largest gap"), first(new, "zone_id", "v", "4 leading zone in new demand"), first(kinds, "intervention", "v", "5 most frequent intervention")):
        out = out.unionByName(p)
    return out


def _findings_sql() -> str:
    from gridloom.plans.marts_sql import rounded

    first = lambda name, key, value, source: f"SELECT * FROM (SELECT '{name}' AS finding, CAST({key} AS VARCHAR) AS entity, CAST({value} AS DOUBLE) AS value FROM ({source}) ORDER BY {rounded(f'CAST({value} AS DOUBLE)', 4, NUDGE)} DESC NULLS LAST, {key} LIMIT 1)"
    return " UNION ALL ".join([
        "SELECT '1 congestion of the ten leading nodes' AS finding, 'nodes' AS entity, CAST(sum(h) AS DOUBLE) AS value FROM (SELECT feeder_id, count_if(congested) AS h FROM node_state GROUP BY zone_id, station_id, feeder_id ORDER BY h DESC, feeder_id LIMIT 10)",
        first("2 leading zone in unserved energy", "zone_id", "v", "SELECT zone_id, sum(ens_mwh) AS v FROM zone_day GROUP BY 1"),
        first("3 largest gap", "zone_id", "gap_mw", "SELECT * FROM flex_gap"),
        first("4 leading zone in new demand", "zone_id", "v", "SELECT zone_id, (sum(ev_mwh) + sum(industry_mwh)) / (sum(ev_mwh) + sum(industry_mwh) + 1) AS v FROM zone_day GROUP BY 1"),
        first("5 most frequent intervention", "intervention", "v", "SELECT intervention, count(*) AS v FROM ranking GROUP BY 1"),
    ])


def extremes(m: Decisions) -> DataFrame:
    """The three cheapest and the three dearest scenarios."""
    m.keep("scenario_summary")
    cost = round_away("cost", 2, NUDGE)
    one = lambda side, by: m.scenario_summary.withColumn("place", F.row_number().over(Window.orderBy(by, "scenario"))).where("place <= 3").select(F.lit(side).alias("side"), "place", "scenario", "cost", "investment")
    return one("best", cost.asc()).unionByName(one("worst", cost.desc()))  # a row for each scenario


def _extremes_sql() -> str:
    from gridloom.plans.marts_sql import rounded

    one = lambda side, way: f"SELECT * FROM (SELECT '{side}' AS side, row_number() OVER (ORDER BY {rounded('cost', 2, NUDGE)} {way}, scenario) AS place, scenario, cost, investment FROM scenario_summary) WHERE place <= 3"
    return f"{one('best', 'ASC')} UNION ALL {one('worst', 'DESC')}"


def drivers(m: Decisions) -> DataFrame:
    """How the zones divide over drivers and interventions, in percent."""
    rows = F.explode(F.array(F.struct(F.lit("driver").alias("kind"), F.col("driver").alias("value")), F.struct(F.lit("intervention").alias("kind"), F.col("intervention").alias("value"))))
    n = m.ranking.select(rows.alias("r")).select("r.*").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.lit(100.0) * ratio("n", F.sum("n").over(Window.partitionBy("kind"))))


_profile_columns = "zone_id zone_name zone_type region ~risk_score:3 #congested_hours ~ens_mwh ~priority:3 tier urgency_tier driver intervention sequence confidence decision ~capex_total:2 ~risk_cost:2 ~mean_horizon #n_outages ~mean_minutes ~congestion_share ~ev_mwh ~industry_mwh ~new_mwh ~new_ratio"
_figure_columns = "#n_zones #congested_hours ~ens_mwh:2 ~mean_load ~overloaded_pct ~resilience:3 ~risk_cost:2 ~capex_total:2 ~deferrable_pct #customers ~saidi ~saifi ~new_mwh:2 ~new_ratio #deferrable_decisions ~mean_gap_mw"

QUERIES = [
    Query("dash_feeder_criticality", "zone_id station_id feeder_id asset_type #n_assets ~mean_exposure ~mean_p ~ens_mwh ~criticality:3", feeder_rank, FEEDER_RANK),
    Query("dash_interruptions", "zone_id #n_outages #customers ~ens_mwh ~mean_minutes ~congestion_share", interruptions, INTERRUPTIONS),
    Query("dash_options", "option ~impact:3 ~cost:2 ~time:3 ~robustness ~option_score:3", lambda m: m.options.groupBy("option").agg(*(F.avg(c).alias(c) for c in ("impact", "cost", "time", "robustness", "option_score"))),
          "SELECT option, avg(impact) AS impact, avg(cost) AS cost, avg(time) AS time, avg(robustness) AS robustness, avg(option_score) AS option_score FROM options GROUP BY 1", more=ALL),
    Query("dash_zone_profile", _profile_columns, profile, PROFILE, more=ALL),
    Query("dash_scenario_top5", "scenario zone_id #rank ~scenario_priority:3 tier intervention", lambda m: m.scenarios.where("rank <= 5"), "SELECT * FROM scenarios WHERE rank <= 5", more=ALL),
    Query("dash_kpi_scalars", SCALAR_COLUMNS, scalars, SCALARS, more=ALL),
    Query("dash_filtered_kpis", _figure_columns, lambda m: figures(m, filtered(m, region="ASIA", asset_type="MACHINERY")), figures_sql(f"SELECT * FROM ({PROFILE}) WHERE region = 'ASIA' AND zone_id IN (SELECT zone_id FROM ({FEEDERS}) WHERE asset_type = 'MACHINERY')"), more=ALL),
    Query("dash_benchmarks", "kpi ~value:3 ~target:2 rule light", benchmarks, f"WITH board AS ({figures_sql(PROFILE)}) {BENCHMARKS}", more=ALL),
    Query("dash_sequences", "sequence #n", lambda m: m.ranking.groupBy(known("sequence", "sin_secuencia").alias("sequence")).agg(F.count(F.lit(1)).alias("n")), "SELECT coalesce(sequence, 'sin_secuencia') AS sequence, count(*) AS n FROM ranking GROUP BY 1", more=ALL),
    Query("dash_drill_down", "zone_id zone_name ~priority:3 tier intervention sequence ~ens_mwh #congested_hours ~mean_max_load ~flex_gap ~electrification ~capex_total:2 driver decision confidence option ~option_score:3 ~impact:3 ~cost:2 #place", drill_down,
          f"SELECT z.*, o.option, o.option_score, o.impact, o.cost, row_number() OVER (ORDER BY round(o.option_score, 6) DESC, o.option) AS place FROM (SELECT * FROM ({PROFILE}) ORDER BY round(priority, 6) DESC, zone_id LIMIT 1) z LEFT JOIN options o USING (zone_id)", more=ALL),
    Query("dash_decisions", "#reinforce #flexible #storage #monitor ~mean_priority:3 ~capex:2 leaders", decisions,
          "SELECT count_if(intervention = 'reforzar_red_local') AS reinforce, count_if(intervention IN ('activar_flexibilidad', 'optimizar_operacion')) AS flexible, count_if(intervention = 'desplegar_almacenamiento') AS storage, count_if(intervention = 'monitorizar') AS monitor, avg(priority) AS mean_priority, sum(capex_total) AS capex, "
          "(SELECT string_agg(CAST(zone_id AS VARCHAR), ', ' ORDER BY p DESC, zone_id) FROM (SELECT zone_id, round(priority, 6) AS p FROM ranking ORDER BY p DESC, zone_id LIMIT 5)) AS leaders FROM ranking", more=ALL),
    Query("dash_driver_mix", "kind value #n ~pct:2", drivers, "SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY kind) AS pct FROM (SELECT 'driver' AS kind, driver AS value, count(*) AS n FROM ranking GROUP BY 2 UNION ALL SELECT 'intervention', intervention, count(*) FROM ranking GROUP BY 2)", more=ALL),
    Query("chart_bars", "chart entity ~value:2 #place", charts, _charts_sql(), more=ALL),
    Query("chart_heat_map", "zone_id hour_of_day #congested_hours ~mean_load ~stress", heat, "SELECT *, 0.65::DOUBLE * (mean_load / 1.2::DOUBLE) + 0.35::DOUBLE * share AS stress FROM (SELECT zone_id, hour_of_day, count_if(congested) AS congested_hours, avg(load_ratio) AS mean_load, avg(CAST(congested AS INT)) AS share FROM node_state GROUP BY 1, 2)"),
    Query("chart_drivers", f"zone_id ~priority:3 {' '.join(f'~{s}:3' for s in SCORES)}", lambda m: m.ranking.orderBy(round_away("priority", 6).desc(), "zone_id").limit(SHOWN), f"SELECT * FROM ranking ORDER BY round(priority, 6) DESC, zone_id LIMIT {SHOWN}", more=ALL),
    Query("analysis_health", "month ~mean_load #congested_hours #stressed_hours", lambda m: m.node_state.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.avg("load_ratio").alias("mean_load"), count_if(F.col("congested")).alias("congested_hours"), count_if(F.col("stressed")).alias("stressed_hours")),
          "SELECT strftime(ts, '%Y-%m') AS month, avg(load_ratio) AS mean_load, count_if(congested) AS congested_hours, count_if(stressed) AS stressed_hours FROM node_state GROUP BY 1"),
    Query("analysis_nodes", "zone_id station_id feeder_id #congested_hours ~max_load ~mean_load", lambda m: m.node_state.groupBy("zone_id", "station_id", "feeder_id").agg(count_if(F.col("congested")).alias("congested_hours"), F.max("load_ratio").alias("max_load"), F.avg("load_ratio").alias("mean_load")),
          "SELECT zone_id, station_id, feeder_id, count_if(congested) AS congested_hours, max(load_ratio) AS max_load, avg(load_ratio) AS mean_load FROM node_state GROUP BY 1, 2, 3"),
    Query("analysis_service", "zone_id ~ens_mwh #customers ~risk_cost:2 #congested_hours", lambda m: m.zone_day_features.groupBy("zone_id").agg(*(F.sum(c).alias(c) for c in ("ens_mwh", "customers", "risk_cost", "congested_hours"))),
          "SELECT zone_id, sum(ens_mwh) AS ens_mwh, sum(customers) AS customers, sum(risk_cost) AS risk_cost, sum(congested_hours) AS congested_hours FROM zone_day_features GROUP BY 1"),
    Query("analysis_flexibility", "zone_id ~critical_mw ~support_mw ~gap_mw ~flex_cost ~flex_ratio ~risk_score", lambda m: m.flex_gap, "SELECT * FROM flex_gap"),
    Query("analysis_electrification", "zone_id ~ev_mwh ~industry_mwh ~curtailment_mwh #congested_hours ~new_ratio", lambda m: m.zone_day.groupBy("zone_id").agg(*(F.sum(c).alias(c) for c in ("ev_mwh", "industry_mwh", "curtailment_mwh", "congested_hours"))).withColumn("new_ratio", (F.col("ev_mwh") + F.col("industry_mwh")) / (F.col("ev_mwh") + F.col("industry_mwh") + F.lit(1.0))),
          "SELECT *, (ev_mwh + industry_mwh) / (ev_mwh + industry_mwh + 1) AS new_ratio FROM (SELECT zone_id, sum(ev_mwh) AS ev_mwh, sum(industry_mwh) AS industry_mwh, sum(curtailment_mwh) AS curtailment_mwh, sum(congested_hours) AS congested_hours FROM zone_day GROUP BY 1)"),
    Query("analysis_economics", "zone_id ~priority:3 ~economic_priority_score:3 intervention sequence urgency_tier tier", lambda m: m.ranking, "SELECT * FROM ranking", more=ALL),
    Query("analysis_findings", "finding entity ~value", findings, _findings_sql(), more=ALL),
    Query("scenario_extremes", "side #place scenario ~cost:2 ~investment:2", extremes, _extremes_sql(), more=ALL),
]
