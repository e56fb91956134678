"""Queries of the KPI reports, the data checks, and the operator presentations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.exprs import count_if, ratio, round_away
from gridloom.operators.intervals import islands
from gridloom.plans.decisions import Decisions
from gridloom.plans.query import NUDGE, Query


def _top(df: DataFrame, k: int, first: str, digits: int, second: str, *keys: str, ascending: bool = False) -> DataFrame:
    """The ``k`` first rows by a rounded figure, then a second one, then the keys."""
    by = round_away(F.col(first).cast("double"), digits, NUDGE)
    other = round_away(F.col(second).cast("double"), 2, NUDGE)
    return df.orderBy(by.asc_nulls_last() if ascending else by.desc_nulls_last(), other.desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in keys)).limit(k)


def _top_sql(source: str, k: int, first: str, digits: int, second: str, *keys: str, ascending: bool = False) -> str:
    from gridloom.plans.marts_sql import rounded

    order = [f"{rounded(f'CAST({first} AS DOUBLE)', digits, NUDGE)} {'ASC' if ascending else 'DESC'} NULLS LAST", f"{rounded(f'CAST({second} AS DOUBLE)', 2, NUDGE)} DESC NULLS LAST", *(f"{c} ASC NULLS LAST" for c in keys)]
    return f"SELECT * FROM ({source}) AS t ORDER BY {', '.join(order)} LIMIT {k}"


def _stations(m: Decisions) -> DataFrame:
    n = m.node_state.groupBy("zone_id", "station_id").agg(F.count(F.lit(1)).alias("hours"), count_if(F.col("congested")).alias("congested_hours"), F.sum("event_energy_mwh").alias("event_energy_mwh"), F.max("load_ratio").alias("max_load"), F.avg("load_ratio").alias("mean_load"))
    return n.withColumn("congested_pct", F.lit(100.0) * ratio("congested_hours", "hours"))


STATIONS = "SELECT zone_id, station_id, count(*) AS hours, count_if(congested) AS congested_hours, sum(event_energy_mwh) AS event_energy_mwh, max(load_ratio) AS max_load, avg(load_ratio) AS mean_load, 100.0::DOUBLE * count_if(congested) / nullif(count(*), 0) AS congested_pct FROM node_state GROUP BY 1, 2"


def _feeders(m: Decisions) -> DataFrame:
    return m.asset_exposure.groupBy("zone_id", "station_id", "feeder_id").agg(F.count("asset_id").alias("n_assets"), F.avg("exposure_score").alias("mean_exposure"), F.max("exposure_score").alias("max_exposure"), F.avg("adjusted_p").alias("mean_p"), F.sum("station_ens_mwh").alias("ens_mwh"))


FEEDERS = "SELECT zone_id, station_id, feeder_id, count(asset_id) AS n_assets, avg(exposure_score) AS mean_exposure, max(exposure_score) AS max_exposure, avg(adjusted_p) AS mean_p, sum(station_ens_mwh) AS ens_mwh FROM asset_exposure GROUP BY 1, 2, 3"


def _deferrable(m: Decisions) -> DataFrame:
    of = lambda s: F.sum(F.when(F.col("strategy") == s, F.col("capex")).otherwise(0.0))
    z = m.candidates.groupBy("zone_id").agg(of("refuerzo").alias("capex_grid"), of("flexibilidad").alias("capex_flex"), F.avg("priority_score").alias("mean_priority"))
    return z.withColumn("deferrable_capex", F.greatest(F.col("capex_grid") - F.col("capex_flex"), F.lit(0.0)))


DEFERRABLE = "SELECT *, greatest(capex_grid - capex_flex, 0) AS deferrable_capex FROM (SELECT zone_id, sum(CASE WHEN strategy = 'refuerzo' THEN capex ELSE 0 END) AS capex_grid, sum(CASE WHEN strategy = 'flexibilidad' THEN capex ELSE 0 END) AS capex_flex, avg(priority_score) AS mean_priority FROM candidates GROUP BY 1)"


def _new_demand(m: Decisions) -> DataFrame:
    z = m.zone_month.groupBy("zone_id").agg(*(F.sum(c).alias(c) for c in ("demand_mwh", "ev_mwh", "industry_mwh", "congested_hours")), F.avg("max_load_ratio").alias("mean_max_load"))
    return z.withColumn("new_mwh", F.col("ev_mwh") + F.col("industry_mwh")).withColumn("new_ratio", ratio("new_mwh", "demand_mwh"))


NEW_DEMAND = "SELECT *, ev_mwh + industry_mwh AS new_mwh, (ev_mwh + industry_mwh) / nullif(demand_mwh, 0) AS new_ratio FROM (SELECT zone_id, sum(demand_mwh) AS demand_mwh, sum(ev_mwh) AS ev_mwh, sum(industry_mwh) AS industry_mwh, sum(congested_hours) AS congested_hours, avg(max_load_ratio) AS mean_max_load FROM zone_month GROUP BY 1)"


def _one(df: DataFrame, **observed: Column) -> DataFrame:
    """Several checks' observed values from one aggregate of a table, as rows."""
    one = df.agg(*(F.coalesce(v.cast("long"), F.lit(0).cast("long")).alias(k) for k, v in observed.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check_name"), F.col(k).alias("observed")) for k in observed))).alias("c")).select("c.*")


def _repeated(key: str) -> Column:
    return F.count(F.lit(1)) - F.countDistinct(key)


def _missing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``df`` with whether its key is missing in ``other``; no row is multiplied."""
    there = other.select(F.col(key).alias("there")).distinct()
    return df.join(there, F.col(key) == F.col("there"), "left").withColumn("missing", F.col("there").isNull())


def _tables(m: Decisions) -> list[DataFrame]:
    """The checks' observed values, one scan and aggregate for each table."""
    zones, stations, feeders, events = (m.frame(r) for r in ("zones", "substations", "feeders", "congestion"))
    node = m.node_state.groupBy("ts", "zone_id", "station_id", "feeder_id").agg(F.count(F.lit(1)).alias("n"), count_if(~F.col("load_ratio").between(0, 2.5)).alias("off"))
    late = lambda: count_if(F.col("ts_end") < F.col("ts_start"))
    return [
        _one(_missing(zones, m.zone_risk, "zone_id"), pk_zones=_repeated("zone_id"), zones_without_risk=count_if(F.col("missing"))),
        _one(_missing(stations, zones, "zone_id"), pk_substations=_repeated("station_id"), fk_substations_zone=count_if(F.col("missing"))),
        _one(_missing(feeders, stations, "station_id"), pk_feeders=_repeated("feeder_id"), fk_feeders_substation=count_if(F.col("missing")), capacity_positive=count_if(F.col("capacity_mw") <= 0)),
        _one(m.frame("demand"), demand_not_negative=count_if(F.col("demand_mw") < 0)),
        _one(node, node_hour_duplicates=count_if(F.col("n") > 1), load_in_range=F.sum("off")),
        _one(m.flex_gap, gap_not_negative=count_if(F.col("gap_mw") < 0)),
        _one(events, events_in_order=late()),
        _one(m.outage_overlaps, outages_in_order=late(), flagged_without_overlap=count_if(F.col("congestion_flag") & ~F.col("overlap_flag"))),
    ]


#: Name, severity and SQL of each check's observed value; 0 passes.
CHECKS = [
    ("pk_zones", "alta", "SELECT count(*) - count(DISTINCT zone_id) FROM zones"),
    ("pk_substations", "alta", "SELECT count(*) - count(DISTINCT station_id) FROM substations"),
    ("pk_feeders", "alta", "SELECT count(*) - count(DISTINCT feeder_id) FROM feeders"),
    ("fk_substations_zone", "alta", "SELECT count(*) FROM substations ANTI JOIN zones USING (zone_id)"),
    ("fk_feeders_substation", "alta", "SELECT count(*) FROM feeders ANTI JOIN substations USING (station_id)"),
    ("demand_not_negative", "alta", "SELECT count(*) FROM demand WHERE demand_mw < 0"),
    ("capacity_positive", "alta", "SELECT count(*) FROM feeders WHERE capacity_mw <= 0"),
    ("node_hour_duplicates", "alta", "SELECT count(*) FROM (SELECT 1 FROM node_state GROUP BY ts, zone_id, station_id, feeder_id HAVING count(*) > 1)"),
    ("load_in_range", "media", "SELECT count(*) FROM node_state WHERE load_ratio < 0 OR load_ratio > 2.5"),
    ("gap_not_negative", "media", "SELECT count(*) FROM flex_gap WHERE gap_mw < 0"),
    ("events_in_order", "alta", "SELECT count(*) FROM congestion WHERE ts_end < ts_start"),
    ("outages_in_order", "alta", "SELECT count(*) FROM outages WHERE ts_end < ts_start"),
    ("flagged_without_overlap", "media", "SELECT count(*) FROM outage_overlaps WHERE congestion_flag AND NOT overlap_flag"),
    ("zones_without_risk", "media", "SELECT count(*) FROM zones ANTI JOIN zone_risk USING (zone_id)"),
]


def checks(m: Decisions) -> DataFrame:
    """Every check's observed value. The marts that several checks read are written once."""
    m.keep("zone_day", "zone_risk", "flex_gap")
    out = reduce(DataFrame.unionByName, _tables(m))
    grave = F.create_map(*(F.lit(x) for name, severity, _ in CHECKS for x in (name, severity)))
    return out.withColumns({"severity": grave[F.col("check_name")], "passed": (F.col("observed") == 0).cast("int")})


CHECKS_SQL = "SELECT *, CASE WHEN observed = 0 THEN 1 ELSE 0 END AS passed FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS check_name, '{s}' AS severity, ({q}) AS observed" for n, s, q in CHECKS) + ")"


def _failures(m: Decisions) -> DataFrame:
    rank = F.when(F.col("severity") == "alta", 1).when(F.col("severity") == "media", 2).otherwise(3)
    return checks(m).where("passed = 0").withColumn("severity_order", rank).orderBy("severity_order", "check_name")


def _sessions(m: Decisions) -> DataFrame:
    """Runs of congested hours of a feeder, an hour apart at most."""
    hours = islands(m.node_state.where("congested").select("feeder_id", "ts", "load_ratio"), ["feeder_id"], "ts", 3600)
    return hours.groupBy("feeder_id", "island").agg(F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), F.count(F.lit(1)).alias("hours"), F.max("load_ratio").alias("max_load"))


SESSIONS = ("SELECT feeder_id, island, min(ts) AS ts_start, max(ts) AS ts_end, count(*) AS hours, max(load_ratio) AS max_load FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY feeder_id ORDER BY ts) AS island "
            "FROM (SELECT feeder_id, ts, load_ratio, lag(ts) OVER (PARTITION BY feeder_id ORDER BY ts) AS before FROM node_state WHERE congested)) GROUP BY 1, 2")

QUERIES = [
    Query("kpi_top_zone_risk", "zone_id zone_name zone_type region ~risk_score:2 #congested_hours ~ens_mwh:2 #customers ~electrification ~flex_gap", lambda m: _top(m.zone_risk, 10, "risk_score", 6, "congested_hours", "zone_id"), _top_sql("SELECT * FROM zone_risk", 10, "risk_score", 6, "congested_hours", "zone_id")),
    Query("kpi_top_station_congestion", "zone_id station_id #hours #congested_hours ~event_energy_mwh:2 ~max_load ~mean_load ~congested_pct:2", lambda m: _top(_stations(m), 20, "congested_hours", 0, "event_energy_mwh", "station_id"), _top_sql(STATIONS, 20, "congested_hours", 0, "event_energy_mwh", "station_id")),
    Query("kpi_top_feeder_exposure", "zone_id station_id feeder_id #n_assets ~mean_exposure:2 ~max_exposure:2 ~mean_p ~ens_mwh:2", lambda m: _top(_feeders(m), 20, "mean_exposure", 2, "mean_p", "station_id", "feeder_id"), _top_sql(FEEDERS, 20, "mean_exposure", 2, "mean_p", "station_id", "feeder_id")),
    Query("kpi_zone_ens", "zone_id zone_name zone_type region ~ens_mwh:2 #customers #congested_hours ~risk_score:2", lambda m: _top(m.zone_risk, 10, "ens_mwh", 6, "customers", "zone_id"), _top_sql("SELECT * FROM zone_risk", 10, "ens_mwh", 6, "customers", "zone_id")),
    Query("kpi_worst_flex_ratio", "zone_id zone_name zone_type region ~flex_ratio ~gap_mw:3 ~economic_gap:2 ~risk_score:2 #congested_hours", lambda m: _top(m.flex_gap, 10, "flex_ratio", 6, "gap_mw", "zone_id", ascending=True), _top_sql("SELECT * FROM flex_gap", 10, "flex_ratio", 6, "gap_mw", "zone_id", ascending=True)),
    Query("kpi_deferrable_capex", "zone_id ~capex_grid:2 ~capex_flex:2 ~deferrable_capex:2 ~mean_priority:2", lambda m: _top(_deferrable(m), 10, "deferrable_capex", 2, "mean_priority", "zone_id"), _top_sql(DEFERRABLE, 10, "deferrable_capex", 2, "mean_priority", "zone_id")),
    Query("kpi_exposed_assets", "asset_id asset_type zone_id station_id feeder_id age_years ~health ~criticality ~failure_p ~adjusted_p ~exposure_score:2 #stressed_hours ~event_energy_mwh:2", lambda m: _top(m.asset_exposure, 25, "exposure_score", 6, "adjusted_p", "asset_id"), _top_sql("SELECT * FROM asset_exposure", 25, "exposure_score", 6, "adjusted_p", "asset_id")),
    Query("kpi_new_demand", "zone_id ~ev_mwh:2 ~industry_mwh:2 ~new_mwh:2 ~new_ratio ~mean_max_load #congested_hours", lambda m: _top(_new_demand(m), 10, "new_ratio", 4, "new_mwh", "zone_id"), _top_sql(NEW_DEMAND, 10, "new_ratio", 4, "new_mwh", "zone_id")),
    Query("dq_pk_fk_domain", "check_name severity #observed passed", checks, CHECKS_SQL),
    Query("dq_failures_ordered", "check_name severity #observed passed severity_order", _failures, f"SELECT *, CASE severity WHEN 'alta' THEN 1 WHEN 'media' THEN 2 ELSE 3 END AS severity_order FROM ({CHECKS_SQL}) WHERE passed = 0"),
    Query("sessionize_events", "feeder_id #island ^ts_start ^ts_end #hours ~max_load", _sessions, SESSIONS),
    Query("dash_month_trend", "@month ~demand_mwh ~net_load_mwh #congested_hours ~ens_mwh ~ev_mwh ~industry_mwh", lambda m: m.zone_month.groupBy("month").agg(*(F.sum(c).alias(c) for c in ("demand_mwh", "net_load_mwh", "congested_hours", "ens_mwh", "ev_mwh", "industry_mwh"))),
          "SELECT month, sum(demand_mwh) AS demand_mwh, sum(net_load_mwh) AS net_load_mwh, sum(congested_hours) AS congested_hours, sum(ens_mwh) AS ens_mwh, sum(ev_mwh) AS ev_mwh, sum(industry_mwh) AS industry_mwh FROM zone_month GROUP BY 1"),
    Query("dash_region_hour", "region hour_of_day ~mean_load ~congested_share", lambda m: m.node_state.join(m.frame("zones").select("zone_id", "region"), "zone_id").groupBy("region", "hour_of_day").agg(F.avg("load_ratio").alias("mean_load"), F.avg(F.col("congested").cast("int")).alias("congested_share")),
          "SELECT region, hour_of_day, avg(load_ratio) AS mean_load, avg(CAST(congested AS INT)) AS congested_share FROM node_state JOIN zones USING (zone_id) GROUP BY 1, 2"),
    Query("dash_outages", "zone_id #n ~mean_minutes ~ens_mwh #customers", lambda m: m.outages.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.avg("minutes").alias("mean_minutes"), F.sum("ens_mwh").alias("ens_mwh"), F.sum("customers").alias("customers")),
          "SELECT zone_id, count(*) AS n, avg(minutes) AS mean_minutes, sum(ens_mwh) AS ens_mwh, sum(customers) AS customers FROM ranked_outages GROUP BY 1"),
    Query("dash_horizon_plan", "zone_id #short #middle #long ~capex:2", lambda m: m.candidates.groupBy("zone_id").agg(count_if(F.col("horizon_months") <= 12).alias("short"), count_if(F.col("horizon_months").between(13, 24)).alias("middle"), count_if(F.col("horizon_months") > 24).alias("long"), F.sum("capex").alias("capex")),
          "SELECT zone_id, count_if(horizon_months <= 12) AS short, count_if(horizon_months BETWEEN 13 AND 24) AS middle, count_if(horizon_months > 24) AS long, sum(capex) AS capex FROM candidates GROUP BY 1"),
]
