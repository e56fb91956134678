"""Single operators on groups: aggregates, windows, orders, profiles, and the presentations made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import count_if, ratio, round_away
from gridloom.operators.forecasting import metrics
from gridloom.operators.quantiles import group_percentile, quantiles
from gridloom.operators.ranking import numbered
from gridloom.operators.scales import min_max, min_max_within, percent_of_max, share_of_max, with_totals
from gridloom.plans.decisions import Decisions
from gridloom.plans.marts_sql import rounded
from gridloom.plans.q_kpi import CHECKS, _top, _top_sql, checks
from gridloom.plans.query import NUDGE, Query

HOUR = "^ts feeder_id"
#: Tables, their keys and the column whose nulls are counted.
PROFILED = {"customer": ("c_custkey", "c_acctbal"), "orders": ("o_orderkey", "o_custkey"), "part": ("p_partkey", "p_retailprice"), "supplier": ("s_suppkey", "s_acctbal")}


def _order_quantiles(m: Decisions) -> DataFrame:
    return quantiles(m.table("orders"), ["o_orderstatus"], "o_totalprice", {"middle": 0.5, "p95": 0.95}, m.once)


def _table(name: str, columns: str, plan, body: str) -> Query:
    """A query on the general tables alone."""
    return Query(name, columns, plan, body, layers=False)


def _zone_hours(m: Decisions) -> DataFrame:
    return m.frame("demand").groupBy("ts", "zone_id").agg(F.sum("demand_mw").alias("zone_mw"))


def _fan_out(m: Decisions) -> DataFrame:
    """A substation's capacity counts once for each of its feeders, as the domain has it."""
    stations = m.frame("substations").select("station_id", "zone_id", F.col("capacity_mw").alias("s_mw"))
    return stations.join(m.frame("feeders"), "station_id").groupBy("zone_id").agg(F.sum("s_mw").alias("stations_mw"), F.sum("capacity_mw").alias("feeders_mw"))


def _excess(m: Decisions) -> DataFrame:
    feeders = m.frame("feeders").select("feeder_id", "capacity_mw")
    return m.frame("demand").join(feeders, "feeder_id").groupBy("zone_id").agg(F.sum(F.greatest(F.col("demand_mw") - F.col("capacity_mw"), F.lit(0.0))).alias("excess_mwh"))


def _top_values(m: Decisions) -> DataFrame:
    """The three most frequent values of each column, all columns in one pass."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in ("c_mktsegment", "c_nationkey"))))
    n = m.table("customer").select(values.alias("v")).select("v.*").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return n.withColumn("place", place).where("place <= 3")


def _nulls(m: Decisions) -> DataFrame:
    """Null counts of all columns in one aggregate, turned into rows."""
    df = m.frame("assets")
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *(count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.select("n_rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.coalesce(c, F.lit(0)).alias("nulls")) for c in df.columns))).alias("c")).select("n_rows", "c.*")


NULLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count_if({c} IS NULL) AS nulls FROM assets" for c in ("asset_id", "asset_type", "station_id", "feeder_id", "age_years", "health", "failure_p", "criticality", "capex"))


def _days(m: Decisions) -> DataFrame:
    return m.table("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("actual"))


DAYS = "SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS actual FROM events GROUP BY 1, 2"


def _naive_errors(m: Decisions) -> DataFrame:
    past = F.lag("actual").over(Window.partitionBy("event_type").orderBy("day"))
    return _days(m).withColumn("predicted", past).where("predicted IS NOT NULL").withColumn("error", F.col("predicted") - F.col("actual")).groupBy("event_type").agg(*metrics(), F.count(F.lit(1)).alias("n"))


def _split(m: Decisions) -> DataFrame:
    """Nations above and below the median of their mean balances, rounded first so that equal figures compare equal."""
    means = m.table("customer").groupBy("c_nationkey").agg(round_away(F.avg("c_acctbal"), 2, NUDGE).alias("mean_balance"))
    return with_totals(means, middle=F.median("mean_balance")).withColumn("half", F.when(F.col("mean_balance") >= F.col("middle"), "upper").otherwise("lower"))


def _modes(m: Decisions) -> DataFrame:
    n = m.table("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("c_nationkey")
    return n.withColumns({"share": ratio("n", F.sum("n").over(w)), "place": F.row_number().over(w.orderBy(F.desc("n"), "c_mktsegment"))}).where("place = 1")


def _rolling(m: Decisions) -> DataFrame:
    """All frames of a feeder's hours over one sort."""
    own = Window.partitionBy("feeder_id").orderBy("ts")
    flag = F.when(F.col("demand_mw") >= 100, 1).otherwise(0)
    day, week, month, ahead = own.rowsBetween(-23, 0), own.rowsBetween(-167, 0), own.rowsBetween(-719, 0), own.rowsBetween(0, 47)
    out = m.frame("demand").select("ts", "feeder_id", "demand_mw", flag.alias("high"))
    out = out.withColumns({"volatility": F.stddev_samp("demand_mw").over(day), "mean_24": F.avg("demand_mw").over(day), "max_168": F.max("demand_mw").over(week), "high_168": F.sum("high").over(week), "high_720": F.sum("high").over(month), "high_ahead": F.max("high").over(ahead), "spread": F.stddev_samp("demand_mw").over(Window.partitionBy("feeder_id"))})
    return out.withColumn("z", ratio(F.col("demand_mw") - F.col("mean_24"), "spread"))


_own = "PARTITION BY feeder_id ORDER BY ts ROWS BETWEEN"
ROLLING = ("SELECT *, (demand_mw - mean_24) / nullif(spread, 0) AS z FROM (SELECT ts, feeder_id, demand_mw, "
           f"stddev_samp(demand_mw) OVER ({_own} 23 PRECEDING AND CURRENT ROW) AS volatility, avg(demand_mw) OVER ({_own} 23 PRECEDING AND CURRENT ROW) AS mean_24, max(demand_mw) OVER ({_own} 167 PRECEDING AND CURRENT ROW) AS max_168, "
           f"sum(high) OVER ({_own} 167 PRECEDING AND CURRENT ROW) AS high_168, sum(high) OVER ({_own} 719 PRECEDING AND CURRENT ROW) AS high_720, max(high) OVER ({_own} CURRENT ROW AND 47 FOLLOWING) AS high_ahead, "
           "stddev_samp(demand_mw) OVER (PARTITION BY feeder_id) AS spread FROM (SELECT *, CASE WHEN demand_mw >= 100 THEN 1 ELSE 0 END AS high FROM demand))")


def _min_periods(m: Decisions) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-29, 0)
    enough = F.count("actual").over(w) >= 7
    return _days(m).withColumns({"mean_30": F.when(enough, F.avg("actual").over(w)), "std_30": F.when(enough, F.stddev_samp("actual").over(w))})


def _months(m: Decisions) -> DataFrame:
    return m.table("orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_orderpriority").alias("some_priority"))


MONTHS = "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, sum(o_totalprice) AS total, max(o_orderpriority) AS some_priority FROM orders GROUP BY 1"


def _scaled(m: Decisions) -> DataFrame:
    suppliers = m.table("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return min_max(suppliers, ["s_acctbal"]).withColumn("within", min_max_within("s_acctbal", ["s_nationkey"]))


def _ranked_parts(m: Decisions) -> DataFrame:
    return m.table("part").withColumn("rank", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")))


RANKED_PARTS = "SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part"


def _buyers(m: Decisions) -> DataFrame:
    return m.table("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n_orders"))


BUYERS = "SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n_orders FROM orders GROUP BY 1"


def _profile(m: Decisions) -> DataFrame:
    parts = [m.table(t).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("keys"), count_if(F.col(c).isNull()).alias("nulls")).select(F.lit(t).alias("table_name"), "n_rows", "keys", F.coalesce("nulls", F.lit(0)).alias("nulls")) for t, (key, c) in PROFILED.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PROFILE = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(DISTINCT {key}) AS keys, count_if({c} IS NULL) AS nulls FROM {t}" for t, (key, c) in PROFILED.items())


def _gates(m: Decisions) -> DataFrame:
    """One row for each severity: its failed checks, and whether a release may pass."""
    out = checks(m).groupBy("severity").agg(F.count(F.lit(1)).alias("checks"), count_if(F.col("observed") > 0).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "PASS").when(F.col("severity") == "alta", "FAIL").otherwise("WARN"))


GATES = "SELECT *, CASE WHEN failed = 0 THEN 'PASS' WHEN severity = 'alta' THEN 'FAIL' ELSE 'WARN' END AS status FROM (SELECT severity, count(*) AS checks, count_if(observed > 0) AS failed FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS severity, ({q}) AS observed" for _, s, q in CHECKS) + ") GROUP BY 1)"


PROBE = 5


def _probed(m: Decisions) -> DataFrame:
    """Whether tables have rows, from a few of them."""
    parts = [m.table(t).limit(PROBE).agg(F.count(F.lit(1)).alias("probed")).select(F.lit(t).alias("table_name"), (F.col("probed") > 0).alias("filled"), "probed") for t in PROFILED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Kinds of column types, as both engines name them.
KINDS = {"int": "number", "bigint": "number", "double": "number", "string": "text", "timestamp_ntz": "time", "timestamp": "time"}
CATALOGUED = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
}
CATALOGUE = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT CASE WHEN data_type IN ('INTEGER', 'BIGINT', 'DOUBLE') THEN 'number' WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type LIKE 'TIMESTAMP%' THEN 'time' ELSE 'other' END FROM information_schema.columns WHERE table_name = '{t}' AND column_name = '{c}') AS kind, "
    f"count({c}) AS filled, count(DISTINCT {c}) AS n_values FROM {t}" for t, columns in CATALOGUED.items() for c in columns)


def _catalogue(m: Decisions) -> DataFrame:
    """Columns of the tables, their kinds by the schemas, and how many rows and different values each has; one aggregate a table."""
    parts = []
    for t in PROFILED:
        df = m.table(t)
        # a row for each column and value: distinct counts of all columns from one aggregate instead of one a column
        values = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(KINDS.get(k, "other")).alias("kind"), F.col(c).cast("string").alias("value")) for c, k in df.dtypes)))
        n = df.select(values.alias("x")).select("x.*").groupBy("column_name", "kind", "value").agg(F.count("value").alias("n"))
        parts.append(n.groupBy("column_name", "kind").agg(F.sum("n").alias("filled"), F.count("value").alias("n_values")).withColumn("table_name", F.lit(t)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ordered(m: Decisions, df: DataFrame, by: str, descending: bool, tie: str) -> DataFrame:
    """Rows with their place in an order that the caller names, counted in ranges of that order."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return numbered(df, [order, F.col(tie)], lambda d: m.once(d, "ordered"), "place")


def _crossed_times(m: Decisions) -> DataFrame:
    reversed_ = lambda role: m.frame(role).agg(F.coalesce(count_if(F.col("ts_end") < F.col("ts_start")), F.lit(0)).alias("observed")).withColumn("rule", F.lit(f"{role}_reversed"))
    more = m.zone_hour.agg(F.coalesce(count_if(F.col("curtailment_mw") > F.col("generation_mw")), F.lit(0)).alias("observed")).withColumn("rule", F.lit("curtailment_over_generation"))
    return reversed_("congestion").unionByName(reversed_("outages")).unionByName(more)


def _mm_sql(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 50 ELSE 100::DOUBLE * ({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) END"


def _blocks(m: Decisions) -> DataFrame:
    """The analysis blocks as one long table, from a single pass over the zone-days."""
    keys = (("region", F.col("region"), F.col("demand_mwh")), ("zone_type", F.col("zone_type"), F.col("ens_mwh")), ("month", F.date_format("day", "yyyy-MM"), F.col("congested_hours").cast("double")), ("electrification", F.col("region"), F.col("ev_mwh") + F.col("industry_mwh")))
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("block"), k.alias("key"), v.alias("value")) for b, k, v in keys)))
    return m.zone_day.select(rows.alias("r")).select("r.*").groupBy("block", "key").agg(F.sum("value").alias("value"))


BLOCKS = ("SELECT 'region' AS block, region AS key, sum(demand_mwh) AS value FROM zone_day GROUP BY 2 UNION ALL SELECT 'zone_type', zone_type, sum(ens_mwh) FROM zone_day GROUP BY 2 "
          "UNION ALL SELECT 'month', strftime(day, '%Y-%m'), sum(congested_hours) FROM zone_day GROUP BY 2 UNION ALL SELECT 'electrification', region, sum(ev_mwh + industry_mwh) FROM zone_day GROUP BY 2")

QUERIES = [
    Query("agg_zone_day", "@day zone_id ~demand_mwh ~peak_mw ~mean_mw #high_hours",
          lambda m: m.frame("demand").groupBy(F.to_date("ts").alias("day"), "zone_id").agg(F.sum("demand_mw").alias("demand_mwh"), F.max("demand_mw").alias("peak_mw"), F.avg("demand_mw").alias("mean_mw"), count_if(F.col("demand_mw") >= 100).alias("high_hours")),
          "SELECT CAST(ts AS DATE) AS day, zone_id, sum(demand_mw) AS demand_mwh, max(demand_mw) AS peak_mw, avg(demand_mw) AS mean_mw, count_if(demand_mw >= 100) AS high_hours FROM demand GROUP BY 1, 2"),
    Query("agg_two_level_peak", "zone_id ~peak_mw ~mean_mw", lambda m: _zone_hours(m).groupBy("zone_id").agg(F.max("zone_mw").alias("peak_mw"), F.avg("zone_mw").alias("mean_mw")),
          "SELECT zone_id, max(zone_mw) AS peak_mw, avg(zone_mw) AS mean_mw FROM (SELECT ts, zone_id, sum(demand_mw) AS zone_mw FROM demand GROUP BY 1, 2) GROUP BY 1"),
    Query("agg_fanout_capacity", "zone_id ~stations_mw ~feeders_mw", _fan_out, "SELECT s.zone_id, sum(s.capacity_mw) AS stations_mw, sum(f.capacity_mw) AS feeders_mw FROM substations s JOIN feeders f USING (station_id) GROUP BY 1"),
    Query("agg_weighted_mean", "zone_id ~cost", lambda m: m.frame("flexibility").groupBy("zone_id").agg(ratio(F.sum(F.col("cost_eur_mwh") * F.col("flex_mw")), F.sum("flex_mw")).alias("cost")), "SELECT zone_id, sum(cost_eur_mwh * flex_mw) / nullif(sum(flex_mw), 0) AS cost FROM flexibility GROUP BY 1"),
    _table("agg_conditional_pivot", "o_orderpriority ~F:2 ~O:2 ~P:2", lambda m: m.table("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice")),
           "SELECT o_orderpriority, " + ", ".join(f"sum(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END) AS {s}" for s in "FOP") + " FROM orders GROUP BY 1"),
    _table("agg_count_distinct", "l_returnflag #n #n_parts #n_suppliers", lambda m: m.table("lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_suppkey").alias("n_suppliers")),
           "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1"),
    _table("agg_month_trunc", "@month #n ~total:2 some_priority", _months, MONTHS),
    Query("agg_positive_gap", "zone_id ~excess_mwh", _excess, "SELECT d.zone_id, sum(greatest(d.demand_mw - f.capacity_mw, 0)) AS excess_mwh FROM demand d JOIN feeders f USING (feeder_id) GROUP BY 1"),
    _table("agg_having_dups", "l_orderkey l_linenumber #n", lambda m: m.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    _table("agg_quantiles", "o_orderstatus ~low:2 ~middle:2 ~p95:2 ~high:2 ~mean:2", lambda m: _order_quantiles(m).join(m.table("orders").groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.avg("o_totalprice").alias("mean")), "o_orderstatus"),
           "SELECT o_orderstatus, min(o_totalprice) AS low, quantile_cont(o_totalprice, 0.5) AS middle, quantile_cont(o_totalprice, 0.95) AS p95, max(o_totalprice) AS high, avg(o_totalprice) AS mean FROM orders GROUP BY 1"),
    _table("agg_corr", "l_returnflag ~r", lambda m: m.table("lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r")), "SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1"),
    _table("agg_top3_values", "column_name value #n #place", _top_values,
           "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS place FROM (SELECT column_name, value, count(*) AS n FROM (SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer) GROUP BY 1, 2)) WHERE place <= 3"),
    Query("agg_null_profile", "column_name #n_rows #nulls", _nulls, NULLS),
    _table("agg_error_metrics", "event_type ~mae:2 ~rmse:2 ~smape:2 ~bias:2 #n", _naive_errors,
           f"SELECT event_type, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(e) / CASE WHEN abs(actual) + abs(predicted) = 0 THEN 1e-9 ELSE (abs(actual) + abs(predicted)) / 2 END) * 100 AS smape, avg(e) AS bias, count(*) AS n FROM (SELECT *, predicted - actual AS e FROM (SELECT *, lag(actual) OVER (PARTITION BY event_type ORDER BY day) AS predicted FROM ({DAYS}))) WHERE predicted IS NOT NULL GROUP BY 1"),
    _table("agg_median_split", "c_nationkey ~mean_balance:2 half", _split,
           f"SELECT *, CASE WHEN mean_balance >= middle THEN 'upper' ELSE 'lower' END AS half FROM (WITH z AS (SELECT c_nationkey, {rounded('avg(c_acctbal)', 2, NUDGE)} AS mean_balance FROM customer GROUP BY 1) SELECT *, (SELECT median(mean_balance) FROM z) AS middle FROM z)"),
    _table("agg_mode_share", "c_nationkey c_mktsegment #n ~share", _modes,
           "SELECT * FROM (SELECT *, n / sum(n) OVER (PARTITION BY c_nationkey) AS share, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS place FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE place = 1"),
    _table("win_share_of_total", "s_suppkey ~share:6", lambda m: m.table("supplier").select("s_suppkey", ratio(F.abs("s_acctbal"), F.sum(F.abs("s_acctbal")).over(Window.partitionBy("s_nationkey"))).alias("share")),
           "SELECT s_suppkey, abs(s_acctbal) / nullif(sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 0) AS share FROM supplier"),
    _table("win_global_max_score", "s_suppkey ~score", lambda m: share_of_max(m.table("supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"]).withColumn("score", percent_of_max("s_acctbal")), "SELECT s_suppkey, 100::DOUBLE * (s_acctbal / nullif(max(s_acctbal) OVER (), 0)) AS score FROM supplier"),
    Query("win_rolling_24", f"{HOUR} ~volatility ~mean_24", _rolling, ROLLING),
    Query("win_rolling_168_720", f"{HOUR} ~max_168 #high_168 #high_720", _rolling, ROLLING),
    _table("win_lag_delta", "@month ~delta:2", lambda m: _months(m).withColumn("delta", F.col("total") - F.lag("total").over(Window.orderBy("month"))), f"SELECT month, total - lag(total) OVER (ORDER BY month) AS delta FROM ({MONTHS})"),
    _table("win_quantile_partition", "s_suppkey ~p95:2", lambda m: group_percentile(m.table("supplier"), "s_nationkey", "s_acctbal", 0.95, "p95", m.once), "SELECT s_suppkey, quantile_cont(s_acctbal, 0.95) OVER (PARTITION BY s_nationkey) AS p95 FROM supplier"),
    _table("win_min_periods", "event_type @day ~mean_30:2 ~std_30:2", _min_periods,
           f"SELECT event_type, day, CASE WHEN n >= 7 THEN mean END AS mean_30, CASE WHEN n >= 7 THEN std END AS std_30 FROM (SELECT event_type, day, count(actual) OVER w AS n, avg(actual) OVER w AS mean, stddev_samp(actual) OVER w AS std FROM ({DAYS}) WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"),
    Query("win_lookahead_48", f"{HOUR} #high_ahead", _rolling, ROLLING),
    Query("win_zscore", f"{HOUR} ~z:3", _rolling, ROLLING),
    _table("win_rank_first", "p_partkey p_type #rank", _ranked_parts, RANKED_PARTS),
    _table("win_topn_per_group", "p_partkey p_type #rank", lambda m: _ranked_parts(m).where("rank <= 5"), f"SELECT * FROM ({RANKED_PARTS}) WHERE rank <= 5"),
    _table("minmax_global_and_group", "s_suppkey ~s_acctbal_mm ~within", _scaled,
           f"SELECT s_suppkey, {_mm_sql('s_acctbal')} AS s_acctbal_mm, 100::DOUBLE * (s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w + 1e-9) AS within FROM supplier WINDOW w AS (PARTITION BY s_nationkey)"),
    _table("topk_two_key", "o_custkey ~total:2 #n_orders", lambda m: _top(_buyers(m), 20, "total", 2, "n_orders", "o_custkey"), _top_sql(BUYERS, 20, "total", 2, "n_orders", "o_custkey")),
    _table("order_case_nulls_last", "segment #n #place", lambda m: m.table("customer").groupBy(F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment")).agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.when(F.col("segment") == "MACHINERY", 1).otherwise(2), F.col("segment").asc_nulls_last()))),
           "SELECT *, row_number() OVER (ORDER BY CASE WHEN segment = 'MACHINERY' THEN 1 ELSE 2 END, segment ASC NULLS LAST) AS place FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS segment, count(*) AS n FROM customer GROUP BY 1)"),
    _table("order_by_parameter", "c_custkey #place", lambda m: ordered(m, m.table("customer").select("c_custkey", "c_acctbal"), "c_acctbal", descending=True, tie="c_custkey"),
           "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer"),
    _table("probe_tables", "table_name filled #probed", _probed, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) > 0 AS filled, count(*) AS probed FROM (SELECT 1 FROM {t} LIMIT {PROBE})" for t in PROFILED)),
    _table("catalogue_columns", "table_name column_name kind #filled #n_values", _catalogue, CATALOGUE),
    Query("agg_pivot_hour", "zone_id " + " ".join(f"#h{h}" for h in range(24)), lambda m: m.node_state.groupBy("zone_id").pivot("hour_of_day", list(range(24))).agg(count_if(F.col("congested"))).fillna(0).toDF("zone_id", *(f"h{h}" for h in range(24))),
          "SELECT zone_id, " + ", ".join(f"count_if(congested AND hour_of_day = {h}) AS h{h}" for h in range(24)) + " FROM node_state GROUP BY 1"),
    _table("distinct_ordered", "value #place", lambda m: m.table("customer").where("c_mktsegment IS NOT NULL").select(F.col("c_mktsegment").alias("value")).distinct().withColumn("place", F.row_number().over(Window.orderBy("value"))),
           "SELECT value, row_number() OVER (ORDER BY value) AS place FROM (SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL)"),
    Query("dq_temporal_cross", "rule #observed", _crossed_times,
          "SELECT 'congestion_reversed' AS rule, count_if(ts_end < ts_start) AS observed FROM congestion UNION ALL SELECT 'outages_reversed', count_if(ts_end < ts_start) FROM outages UNION ALL SELECT 'curtailment_over_generation', count_if(curtailment_mw > generation_mw) FROM zone_hour"),
    Query("dq_release_gates", "severity #checks #failed status", _gates, GATES),
    _table("profile_tables", "table_name #n_rows #keys #nulls", _profile, PROFILE),
    Query("analysis_blocks", "block key ~value:2", _blocks, BLOCKS),
]
