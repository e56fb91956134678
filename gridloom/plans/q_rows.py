"""Single operators on rows: projections, conditions, joins, sets and scalar functions, each on a table that plays its role."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import boundaries, clamp, known, largest_name, last_wins, ratio, round_away
from gridloom.operators.intervals import overlapping_ids
from gridloom.plans.decisions import Decisions
from gridloom.plans.marts import OPERATION, PHYSICAL, STORAGE
from gridloom.plans.marts_sql import rounded
from gridloom.plans.query import Query

NODE_HOUR = ["ts", "zone_id", "station_id", "feeder_id"]
#: Multipliers of the demand that the crossed scenarios take.
GROWTH = {"base": 1.0, "alto": 1.15, "estres": 1.3, "contraccion": 0.9}
REQUIRED = ("view", "signup", "purchase", "refund", "error", "transfer")


def _table(name: str, columns: str, plan, body: str) -> Query:
    """A query on the general tables alone."""
    return Query(name, columns, plan, body, layers=False)


def _family(m: Decisions) -> DataFrame:
    kind = F.col("investment_type")
    family = F.when(kind.isin(*PHYSICAL), "refuerzo_fisico").when(kind.isin(*STORAGE), "storage_distribuido").when(kind.isin(*OPERATION), "operacion_avanzada").otherwise("flexibilidad_operativa")
    return m.frame("investments").select("investment_id", "investment_type", family.alias("family"))


def _search(m: Decisions) -> DataFrame:
    """Customers of a region, of a range of balances, whose words contain a text."""
    near = m.table("nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    words = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment"))
    return m.table("customer").where(F.col("c_acctbal").between(0, 5000) & words.contains("build")).join(near, "c_nationkey", "left_semi")


def _event_hours(m: Decisions) -> DataFrame:
    hours = m.event_hours.groupBy(*NODE_HOUR).agg(F.count("event_id").alias("n_events"), F.sum("hour_energy_mwh").alias("energy_mwh"))
    out = m.frame("demand").select(*NODE_HOUR, "demand_mw").join(hours, NODE_HOUR, "left")
    return out.withColumns({"n_events": known("n_events", 0), "energy_mwh": known("energy_mwh")})


def _null_safe(m: Decisions) -> DataFrame:
    """Assets beside their feeder's mean; those without a feeder form a group of their own."""
    means = m.frame("assets").groupBy(F.col("feeder_id").alias("of_feeder")).agg(F.avg("criticality").alias("mean_criticality"), F.count(F.lit(1)).alias("n_assets"))
    return m.frame("assets").join(means, F.col("feeder_id").eqNullSafe(F.col("of_feeder")))


def _crossed(m: Decisions) -> DataFrame:
    """Zones by scenario: each zone's row is expanded by a literal list, so nothing is shuffled for the product."""
    capex = m.frame("investments").groupBy("zone_id").agg(F.sum("capex").alias("capex"))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("scenario"), F.lit(x).alias("factor")) for s, x in GROWTH.items())))
    return capex.withColumn("s", each).select("zone_id", "s.scenario", (F.col("capex") * F.col("s.factor")).alias("capex"))


def _detectors(m: Decisions) -> DataFrame:
    found = lambda df, kind, key, score: df.select(F.lit(kind).alias("kind"), F.col(key).alias("entity"), F.col(score).alias("score"))
    orders = found(m.table("orders").where("o_totalprice > 300000"), "large_order", "o_orderkey", "o_totalprice")
    low = found(m.table("customer").where("c_acctbal < -500"), "low_balance", "c_custkey", "c_acctbal")
    return orders.unionByName(low).unionByName(found(m.table("supplier").where("s_acctbal < 0"), "low_supplier", "s_suppkey", "s_acctbal"))


def _counts(m: Decisions) -> DataFrame:
    """Checks of two tables: one aggregate a table, its figures turned into rows."""
    def checks(table: str, **bad) -> DataFrame:
        one = m.table(table).agg(*(F.coalesce(F.sum(F.when(b, 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, b in bad.items()))
        return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("observed")) for n in bad))).alias("c")).select("c.*")

    lines = checks("lineitem", quantity_positive=F.col("l_quantity") <= 0, discount_in_range=~F.col("l_discount").between(0, 1), tax_in_range=~F.col("l_tax").between(0, 1))
    return lines.unionByName(checks("orders", price_positive=F.col("o_totalprice") <= 0, status_known=~F.col("o_orderstatus").isin("F", "O", "P")))


def _missing(m: Decisions) -> DataFrame:
    wanted = m.spark.range(1).select(F.explode(F.array(*map(F.lit, REQUIRED))).alias("event_type"))
    return wanted.join(m.table("events"), "event_type", "left_anti")


def _joined(m: Decisions) -> DataFrame:
    """The three largest orders of each priority as text, and the number that stands in its name."""
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    o = m.table("orders").select("o_orderpriority", "o_orderkey", "o_totalprice").withColumn("place", place)
    kept = F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", F.col("o_orderkey").cast("string").alias("k")))))
    return o.groupBy("o_orderpriority").agg(F.array_join(F.transform(kept, lambda x: x["k"]), ", ").alias("leaders"), F.max(F.regexp_extract("o_orderpriority", "[0-9]+", 0).cast("int")).alias("digits"))


QUERIES = [
    _table("scan_cast_projection", "l_orderkey line @day #qty ~price:2 discounted",
           lambda m: m.table("lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("line"), F.to_date("l_shipdate").alias("day"), F.floor("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), (F.col("l_discount") > 0.05).alias("discounted")),
           "SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS line, CAST(l_shipdate AS DATE) AS day, floor(l_quantity) AS qty, l_extendedprice AS price, l_discount > 0.05::DOUBLE AS discounted FROM lineitem"),
    _table("safe_ratio_coalesce", "l_partkey ~discount_to_tax",
           lambda m: m.table("lineitem").groupBy("l_partkey").agg(known(ratio(F.sum("l_discount"), F.sum("l_tax")), -1.0).alias("discount_to_tax")),
           "SELECT l_partkey, coalesce(sum(l_discount) / nullif(sum(l_tax), 0), -1) AS discount_to_tax FROM lineitem GROUP BY 1"),
    _table("clamp_greatest_least", "c_custkey ~balance:2 ~at_most:2",
           lambda m: m.table("customer").select("c_custkey", clamp("c_acctbal", 0.0, 5000.0).alias("balance"), F.least(F.lit(100.0), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))).alias("at_most")),
           "SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS balance, least(100, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END) AS at_most FROM customer"),
    Query("severity_case", "event_id severity #severity_rank", lambda m: m.events, "SELECT * FROM ranked_events"),
    Query("flag_or_thresholds", f"^ts {' '.join(NODE_HOUR[1:])} strained",
          lambda m: m.frame("demand").withColumn("strained", F.coalesce((F.col("demand_mw") >= 100) | (F.col("voltage") < 0.94) | (F.col("temperature") >= 33), F.lit(False))),
          "SELECT *, coalesce(demand_mw >= 100 OR voltage < 0.94::DOUBLE OR temperature >= 33, false) AS strained FROM demand"),
    Query("category_family_in", "investment_id investment_type family", _family,
          f"SELECT *, CASE WHEN investment_type IN {PHYSICAL} THEN 'refuerzo_fisico' WHEN investment_type IN ('{STORAGE[0]}') THEN 'storage_distribuido' WHEN investment_type IN {OPERATION} THEN 'operacion_avanzada' ELSE 'flexibilidad_operativa' END AS family FROM investments"),
    Query("override_ladder", "asset_id measure",
          lambda m: m.frame("assets").withColumn("measure", last_wins(F.lit("monitor"), [(F.col("age_years") >= 40, "renew"), (F.col("failure_p") >= 0.8, "inspect"), (F.col("health") < 20, "immediate")])),
          "SELECT *, CASE WHEN health < 20 THEN 'immediate' WHEN failure_p >= 0.8::DOUBLE THEN 'inspect' WHEN age_years >= 40 THEN 'renew' ELSE 'monitor' END AS measure FROM assets"),
    Query("argmax_driver", "asset_id driver",
          lambda m: m.frame("assets").withColumn("wear", F.lit(1.0) - F.col("health") / F.lit(100.0)).withColumn("driver", largest_name(["wear", "failure_p", "criticality"])),
          "SELECT *, CASE greatest(wear, failure_p, criticality) WHEN wear THEN 'wear' WHEN failure_p THEN 'failure_p' WHEN criticality THEN 'criticality' END AS driver FROM (SELECT *, 1::DOUBLE - health / 100::DOUBLE AS wear FROM assets)"),
    _table("filters_conjunction_search", "c_custkey c_name c_mktsegment ~c_acctbal:2", _search,
           "SELECT * FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'build') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    Query("join_event_hour", f"^ts {' '.join(NODE_HOUR[1:])} ~demand_mw #n_events ~energy_mwh", _event_hours,
          "SELECT d.ts, d.zone_id, d.station_id, d.feeder_id, d.demand_mw, coalesce(e.n_events, 0) AS n_events, coalesce(e.energy_mwh, 0) AS energy_mwh FROM demand d LEFT JOIN (SELECT ts, zone_id, station_id, feeder_id, count(event_id) AS n_events, sum(hour_energy_mwh) AS energy_mwh FROM event_hours GROUP BY ALL) e USING (ts, zone_id, station_id, feeder_id)"),
    Query("semi_overlap_distinct", "outage_id station_id", lambda m: overlapping_ids(m.outages, m.events, "station_id", "outage_id"),
          "SELECT DISTINCT o.outage_id, o.station_id FROM outages o JOIN congestion c ON c.station_id = o.station_id AND c.ts_start <= o.ts_end AND c.ts_end >= o.ts_start"),
    Query("join_null_safe", "asset_id feeder_id ~mean_criticality #n_assets", _null_safe,
          "SELECT a.*, g.mean_criticality, g.n_assets FROM assets a JOIN (SELECT feeder_id AS of_feeder, avg(criticality) AS mean_criticality, count(*) AS n_assets FROM assets GROUP BY 1) g ON a.feeder_id IS NOT DISTINCT FROM g.of_feeder"),
    _table("anti_fk_check", "c_custkey", lambda m: m.table("customer").join(m.table("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti"),
           "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    Query("cross_scenarios", "zone_id scenario ~capex:2", _crossed,
          f"SELECT zone_id, scenario, capex * factor AS capex FROM (SELECT zone_id, sum(capex) AS capex FROM investments GROUP BY 1) CROSS JOIN (VALUES {', '.join(f"('{s}', {x}::DOUBLE)" for s, x in GROWTH.items())}) AS s(scenario, factor)"),
    _table("union_checks", "check_name #observed", _counts,
           "SELECT 'quantity_positive' AS check_name, count_if(l_quantity <= 0) AS observed FROM lineitem UNION ALL SELECT 'discount_in_range', count_if(l_discount NOT BETWEEN 0 AND 1) FROM lineitem UNION ALL SELECT 'tax_in_range', count_if(l_tax NOT BETWEEN 0 AND 1) FROM lineitem "
           "UNION ALL SELECT 'price_positive', count_if(o_totalprice <= 0) FROM orders UNION ALL SELECT 'status_known', count_if(o_orderstatus NOT IN ('F', 'O', 'P')) FROM orders"),
    _table("union_detectors", "kind entity ~score:2", _detectors,
           "SELECT 'large_order' AS kind, o_orderkey AS entity, o_totalprice AS score FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'low_balance', c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500 UNION ALL SELECT 'low_supplier', s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0"),
    _table("set_coverage", "event_type", _missing, f"SELECT event_type FROM (SELECT unnest({list(REQUIRED)}) AS event_type) WHERE event_type NOT IN (SELECT event_type FROM events)"),
    _table("fn_round_half_away", "l_orderkey l_partkey ~whole:1 ~two:2 ~three:3",
           lambda m: m.table("lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").alias("whole"), (F.col("l_extendedprice") * F.col("l_discount")).alias("two"), (F.col("l_tax") - F.col("l_discount")).alias("three")),
           "SELECT l_orderkey, l_partkey, l_extendedprice AS whole, l_extendedprice * l_discount AS two, l_tax - l_discount AS three FROM lineitem"),
    Query("fn_date_boundaries", "event_id #hours #minutes #days",
          lambda m: m.frame("congestion").select("event_id", *(boundaries(u, "ts_start", "ts_end").alias(f"{u}s") for u in ("hour", "minute", "day"))),
          "SELECT event_id, date_diff('hour', ts_start, ts_end) AS hours, date_diff('minute', ts_start, ts_end) AS minutes, date_diff('day', ts_start, ts_end) AS days FROM congestion"),
    _table("fn_trunc_strftime_extract", "event_id @day @month year_month #hour_of_day #month_no ^next_hour",
           lambda m: m.table("events").select("event_id", F.to_date("ts").alias("day"), F.date_trunc("month", "ts").alias("month"), F.date_format("ts", "yyyy-MM").alias("year_month"), F.hour("ts").alias("hour_of_day"), F.month("ts").alias("month_no"), (F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")).alias("next_hour")),
           "SELECT event_id, CAST(ts AS DATE) AS day, date_trunc('month', ts) AS month, strftime(ts, '%Y-%m') AS year_month, hour(ts) AS hour_of_day, month(ts) AS month_no, date_trunc('hour', ts) + INTERVAL 1 HOUR AS next_hour FROM events"),
    _table("fn_string_ids", "event_id code kind first_letters",
           lambda m: m.table("events").select("event_id", F.concat(F.lit("CG"), F.lpad(F.col("event_id").cast("string"), 7, "0")).alias("code"), F.upper("event_type").alias("kind"), F.substring("event_type", 1, 3).alias("first_letters")),
           "SELECT event_id, 'CG' || lpad(CAST(event_id AS VARCHAR), 7, '0') AS code, upper(event_type) AS kind, substring(event_type, 1, 3) AS first_letters FROM events"),
    _table("fn_string_join_find", "o_orderpriority leaders #digits", _joined,
           "SELECT o_orderpriority, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_totalprice DESC, o_orderkey) FILTER (place <= 3) AS leaders, CAST(max(CAST(regexp_extract(o_orderpriority, '[0-9]+', 0) AS INTEGER)) AS BIGINT) AS digits FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) GROUP BY 1"),
    _table("fn_sha256", "c_custkey digest", lambda m: m.table("customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("digest")), "SELECT c_custkey, sha256(concat_ws('|', c_name, c_mktsegment)) AS digest FROM customer"),
    _table("fn_json_payload", "n_nationkey payload", lambda m: m.table("nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("payload")),
           "SELECT n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS payload FROM nation"),
    _table("fn_number_format", "s_suppkey compact grouped", lambda m: m.table("supplier").select("s_suppkey", round_away("s_acctbal", 4).cast("string").alias("compact"), F.format_number(F.floor(F.abs("s_acctbal")), 0).alias("grouped")),
           "SELECT s_suppkey, CAST(" + rounded("s_acctbal", 4) + " AS VARCHAR) AS compact, format('{:,}', CAST(floor(abs(s_acctbal)) AS BIGINT)) AS grouped FROM supplier"),
]
