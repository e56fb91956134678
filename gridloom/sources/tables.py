"""Reading tables, and the grid domain's frames as roles of the general test tables.

The plans work on fifteen domain frames with fixed columns. They come either
from the domain's CSV files (``gridloom.sources.grid_csv``) or, here, from
TPC-H-like tables that play the same roles. The role texts are plain SQL that
Spark and DuckDB read alike, so an oracle starts from the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables that a role reads, and its text.
ROLES: dict[str, tuple[tuple[str, ...], str]] = {
    "zones": (("nation", "region"), """
        SELECT CAST(n_nationkey AS BIGINT) AS zone_id, n_name AS zone_name, r_name AS region,
               CASE n_nationkey % 3 WHEN 0 THEN 'urbana' WHEN 1 THEN 'rural' ELSE 'mixta' END AS zone_type,
               (n_nationkey * 17 % 100) / CAST(100 AS DOUBLE) AS criticality, (n_nationkey * 29 % 100) / CAST(100 AS DOUBLE) AS flex_potential,
               (n_nationkey * 41 % 100) / CAST(100 AS DOUBLE) AS climate_risk, (n_nationkey * 61 % 100) / CAST(100 AS DOUBLE) AS growth_tension
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""),
    "substations": (("events",), """
        SELECT station_id, station_id % 25 AS zone_id, CAST(200 + station_id * 13 % 200 AS DOUBLE) AS capacity_mw,
               CAST(180 + station_id * 11 % 180 AS DOUBLE) AS firm_mw, CAST(station_id * 7 % 45 AS INT) AS age_years
        FROM (SELECT DISTINCT user_id % 50 AS station_id FROM {events}) AS s"""),
    "feeders": (("events",), """
        SELECT user_id AS feeder_id, user_id % 50 AS station_id, CASE user_id % 2 WHEN 0 THEN 'aerea' ELSE 'subterranea' END AS grid_type,
               CAST(40 + user_id * 11 % 90 AS DOUBLE) AS capacity_mw, (user_id * 19 % 100) / CAST(100 AS DOUBLE) AS climate_exposure,
               CAST(30 + user_id * 13 % 80 AS DOUBLE) AS base_load_mw
        FROM (SELECT DISTINCT user_id FROM {events}) AS f"""),
    "demand": (("events",), """
        SELECT ts, user_id % 25 AS zone_id, user_id % 50 AS station_id, user_id AS feeder_id, demand_mw,
               CAST(16 + (hour(ts) * 7 + day(ts) * 3) % 20 AS DOUBLE) AS temperature,
               CASE WHEN day(ts) % 7 IN (0, 6) THEN 'fin_de_semana' ELSE 'laborable' END AS day_type,
               CAST(hour(ts) AS INT) AS hour_of_day, hour(ts) BETWEEN 18 AND 21 AS peak_flag,
               CAST(0.92 AS DOUBLE) + ((user_id * 13 + hour(ts) * 7) % 16) / CAST(100 AS DOUBLE) AS voltage,
               demand_mw * CAST(0.3 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS reactive_mw, CAST(month(ts) AS INT) AS month_of_year
        FROM (SELECT date_trunc('hour', ts) AS ts, user_id, SUM(value) AS demand_mw FROM {events} GROUP BY date_trunc('hour', ts), user_id) AS d"""),
    "generation": (("events",), """
        SELECT date_trunc('hour', ts) AS ts, user_id % 25 AS zone_id, CASE user_id % 2 WHEN 0 THEN 'solar' ELSE 'eolica' END AS technology,
               CAST(0.4 AS DOUBLE) * SUM(value) AS generation_mw, CAST(0.1 AS DOUBLE) * SUM(CASE WHEN value > 60 THEN value ELSE 0 END) AS curtailment_mw,
               CAST(0.3 AS DOUBLE) * SUM(CASE WHEN value > 20 THEN value ELSE value + value END) AS self_use_mw, CAST(0.12 AS DOUBLE) * SUM(CASE WHEN value > 75 THEN value ELSE 0 END) AS spill_mw
        FROM {events} WHERE event_type = 'signup' GROUP BY date_trunc('hour', ts), user_id % 25, CASE user_id % 2 WHEN 0 THEN 'solar' ELSE 'eolica' END"""),
    "ev": (("events",), """
        SELECT date_trunc('hour', ts) AS ts, user_id % 25 AS zone_id, user_id % 3 AS charging_type, CAST(0.25 AS DOUBLE) * SUM(value) AS ev_mw
        FROM {events} WHERE event_type = 'click' GROUP BY date_trunc('hour', ts), user_id % 25, user_id % 3"""),
    "industry": (("events",), """
        SELECT date_trunc('hour', ts) AS ts, user_id % 25 AS zone_id, user_id % 2 AS cluster, CAST(0.2 AS DOUBLE) * SUM(value) AS industry_mw
        FROM {events} WHERE event_type = 'view' GROUP BY date_trunc('hour', ts), user_id % 25, user_id % 2"""),
    "congestion": (("events",), """
        SELECT event_id, date_trunc('hour', ts) AS ts_start, ts + INTERVAL '1' MINUTE * CAST(floor(value) AS INT) AS ts_end, user_id % 25 AS zone_id,
               user_id % 50 AS station_id, user_id AS feeder_id,
               CASE WHEN value >= 100 THEN 'critica' WHEN value >= 50 THEN 'alta' WHEN value >= 20 THEN 'media' ELSE 'baja' END AS severity,
               value * CAST(0.5 AS DOUBLE) AS energy_mwh, event_id % 5 = 0 AS service_flag, value / CAST(25 AS DOUBLE) AS max_ratio
        FROM {events} WHERE event_type = 'error'"""),
    "outages": (("events",), """
        SELECT event_id AS outage_id, ts AS ts_start, ts + INTERVAL '1' MINUTE * CAST(floor(value) AS INT) AS ts_end, user_id % 25 AS zone_id, user_id % 50 AS station_id,
               event_id * 31 % 2000 AS customers, value * CAST(0.2 AS DOUBLE) AS ens_mwh,
               CASE WHEN value >= 100 THEN 'critica' WHEN value >= 50 THEN 'alta' WHEN value >= 20 THEN 'media' ELSE 'baja' END AS severity,
               event_id % 2 = 0 AS congestion_flag
        FROM {events} WHERE event_type = 'purchase'"""),
    "assets": (("customer",), """
        SELECT c_custkey AS asset_id, c_mktsegment AS asset_type, c_custkey % 50 AS station_id,
               CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_custkey % 150 END AS feeder_id, CAST(c_custkey * 7 % 50 AS INT) AS age_years,
               CAST(c_custkey * 13 % 100 AS DOUBLE) AS health, (c_custkey * 17 % 100) / CAST(100 AS DOUBLE) AS failure_p,
               (c_custkey * 23 % 100) / CAST(100 AS DOUBLE) AS criticality, abs(c_acctbal) * 10 AS capex
        FROM {customer}"""),
    "flexibility": (("supplier",), """
        SELECT s_suppkey AS resource_id, CAST(s_nationkey AS BIGINT) AS zone_id, abs(s_acctbal) / 500 AS flex_mw,
               CAST(40 + s_suppkey % 60 AS DOUBLE) AS cost_eur_mwh, (50 + s_suppkey % 50) / CAST(100 AS DOUBLE) AS availability,
               (s_suppkey * 7 % 103) / CAST(100 AS DOUBLE) AS reliability, (s_suppkey * 3 % 90) / CAST(100 AS DOUBLE) AS maturity
        FROM {supplier} WHERE s_suppkey % 3 > 0"""),
    "storage": (("supplier",), """
        SELECT s_suppkey AS storage_id, CAST(s_nationkey AS BIGINT) AS zone_id, abs(s_acctbal) / 200 AS energy_mwh, abs(s_acctbal) / 800 AS power_mw,
               (60 + s_suppkey % 40) / CAST(100 AS DOUBLE) AS availability, (70 + s_suppkey % 33) / CAST(100 AS DOUBLE) AS efficiency
        FROM {supplier} WHERE s_suppkey % 3 = 0"""),
    "interventions": (("supplier",), """
        SELECT s_suppkey AS intervention_id, CAST(s_nationkey AS BIGINT) AS zone_id, abs(s_acctbal) / 400 AS relief_mw, abs(s_acctbal) * 20 AS cost,
               CAST(30 + s_suppkey % 90 AS INT) AS days, (s_suppkey * 7 % 100) / CAST(100 AS DOUBLE) AS complexity
        FROM {supplier} WHERE s_suppkey % 2 = 0"""),
    "investments": (("part",), """
        SELECT p_partkey AS investment_id, p_partkey % 25 AS zone_id,
               CASE p_type WHEN 'STANDARD' THEN 'nuevo_alimentador' WHEN 'PROMO' THEN 'repotenciacion_subestacion' WHEN 'LARGE' THEN 'almacenamiento_red'
                           WHEN 'SMALL' THEN 'automatizacion_avanzada' WHEN 'ECONOMY' THEN 'digitalizacion_protecciones' ELSE 'gestion_demanda' END AS investment_type,
               p_retailprice * 1000 AS capex, (p_size % 10) / CAST(10 AS DOUBLE) AS risk_reduction, CAST(p_size % 20 AS DOUBLE) AS capacity_gain,
               CAST(p_size AS INT) AS horizon_months, (p_partkey * 7 % 100) / CAST(100 AS DOUBLE) AS ease, (p_partkey * 3 % 100) / CAST(100 AS DOUBLE) AS resilience
        FROM {part}"""),
    "macro": (("orders",), """
        SELECT day_no, scenario, 1 + (n % 50) / CAST(1000 AS DOUBLE) AS growth_index, 1 + (n % 30) / CAST(500 AS DOUBLE) AS ev_index
        FROM (SELECT CAST(o_orderkey % 30 + 1 AS INT) AS day_no, CASE o_orderstatus WHEN 'F' THEN 'base' WHEN 'O' THEN 'alto' ELSE 'estres' END AS scenario, COUNT(*) AS n
              FROM {orders} GROUP BY CAST(o_orderkey % 30 + 1 AS INT), CASE o_orderstatus WHEN 'F' THEN 'base' WHEN 'O' THEN 'alto' ELSE 'estres' END) AS m"""),
    # longer series for the forecasts' daily tasks than the events' thirty days, and hours without gaps; the domain's files have none
    "series": (("lineitem", "supplier"), """
        SELECT t.task, z.entity, z.day, CASE t.k WHEN 1 THEN q WHEN 2 THEN q / n WHEN 3 THEN ev ELSE industry END AS value
        FROM (SELECT CAST(CAST(s_nationkey AS BIGINT) AS VARCHAR(20)) AS entity, day, SUM(q) AS q, SUM(ev) AS ev, SUM(industry) AS industry, SUM(n) AS n
              FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, SUM(l_quantity) AS q, SUM(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END) AS ev, SUM(l_quantity * l_discount) AS industry, COUNT(*) AS n
                    FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)) AS d JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY CAST(CAST(s_nationkey AS BIGINT) AS VARCHAR(20)), day) AS z
        CROSS JOIN (VALUES (1, 'demanda_zona'), (2, 'carga_relativa_zona'), (3, 'demanda_ev_zona'), (4, 'demanda_industrial_zona')) AS t(k, task)
        UNION ALL
        SELECT 'demanda_subestacion', CAST(l_suppkey % 50 AS VARCHAR(20)), CAST(l_shipdate AS DATE), SUM(l_quantity) FROM {lineitem} GROUP BY CAST(l_suppkey % 50 AS VARCHAR(20)), CAST(l_shipdate AS DATE)"""),
    "hours": (("events",), """
        SELECT user_id % 2 AS zone_id, date_trunc('hour', ts) AS ts, SUM(value) AS value, MAX(CASE WHEN hour(ts) BETWEEN 18 AND 21 THEN 1 ELSE 0 END) = 1 AS peak
        FROM {events} GROUP BY user_id % 2, date_trunc('hour', ts)"""),
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A Parquet table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain frame made from the general tables; a role that they don't play is a ``KeyError``."""
    tables, text = ROLES[name]
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in tables})


def role_sql() -> str:
    """The roles as common table expressions for an oracle."""
    return ",\n".join(f"{name} AS ({text.format(**{t: t for t in tables})})" for name, (tables, text) in ROLES.items())
