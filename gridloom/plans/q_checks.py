"""Validation rules, gates across outputs, release readiness, and profiles of the domain's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import count_if, known, ratio, round_away
from gridloom.operators.intervals import overlapping_ids
from gridloom.operators.quantiles import quantiles
from gridloom.operators.scoring import SCORES
from gridloom.plans.decisions import Decisions
from gridloom.plans.decisions_sql import ALL, TASKS
from gridloom.plans.q_kpi import CHECKS_SQL, DEFERRABLE, _deferrable, checks
from gridloom.plans.query import Query
from gridloom.sources.grid_csv import FRAMES

# Limits of the rules, and the tasks that a forecast benchmark must cover.
LEAST_ROWS = 1_000_000
MOST_OVERLOADED = 0.45
MOST_RATIO = 5
MOST_SHIFT = 3
TASK_NAMES = ("demanda_zona", "demanda_subestacion", "carga_relativa_zona", "demanda_ev_zona", "demanda_industrial_zona")
# Lowest scores of the tiers.
TIERS = {"critico": (80, None), "alto": (60, 80), "medio": (40, 60), "bajo": (None, 40)}
# The five states of a release by its worst finding.
READINESS = {
    "blocked": ("not technically valid", "not analytically acceptable", "screening-grade only", "not committee-grade", "publish-blocked"),
    "several": ("technically valid", "analytically acceptable", "screening-grade only", "not committee-grade", "publish-blocked"),
    "one": ("technically valid", "analytically acceptable", "decision-support only", "not committee-grade", "publish-with-caveats"),
    "none": ("technically valid", "analytically acceptable", "decision-support ready", "not committee-grade", "publish-with-caveats"),
}
STATES = ("technical", "analytical", "decision", "committee", "publish")


def _one(df: DataFrame, **observed: Column) -> DataFrame:
    """Observed values of several rules from one aggregate of a table, as rows."""
    one = df.agg(*(known(v.cast("double")).alias(k) for k, v in observed.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("observed")) for k in observed))).alias("r")).select("r.*")


def wrong_tier() -> Column:
    """Whether a row's tier isn't that of its priority."""
    at_least = lambda x: F.lit(True) if x is None else F.col("priority") >= x
    below = lambda x: F.lit(True) if x is None else F.col("priority") < x
    return reduce(lambda a, b: a | b, (at_least(lo) & below(hi) & (F.col("tier") != t) for t, (lo, hi) in TIERS.items()))


def out_of_range() -> Column:
    return reduce(lambda a, b: a | b, (~F.col(c).between(0, 100) for c in (*SCORES, "priority")))


#: Area, severity and highest allowed value of each rule (``None``: at least ``LEAST_ROWS``).
RULES: dict[str, tuple[str, str, float | None]] = {
    "row_count_demand": ("generation", "alta", None),
    "duplicates_node_hour": ("sql", "alta", 0),
    "null_zone": ("profiling", "alta", 0),
    "null_time": ("profiling", "alta", 0),
    "null_demand": ("profiling", "alta", 0),
    "negative_demand": ("data", "alta", 0),
    "capacity_not_positive": ("data", "alta", 0),
    "times_reversed": ("temporal", "alta", 0),  # of events and outages: one finding
    "overload_share": ("consistency", "media", MOST_OVERLOADED),
    "flagged_without_overlap": ("consistency", "media", 0),
    "curtailment_over_generation": ("consistency", "alta", 0),
    "zones_without_score": ("scoring", "alta", 0),
    "ratios_out_of_range": ("metrics", "media", 0),
    "scores_out_of_range": ("scoring", "alta", 0),
    "tier_mismatch": ("scoring", "alta", 0),
    "deferrable_over_grid": ("economics", "media", 0),
    "critical_without_action": ("decision", "alta", 0),
}


def _judged(observed: DataFrame) -> DataFrame:
    """Observed values with their rule's area, severity and limit, and whether the rule fails."""
    field = lambda i, kind: F.create_map(*(F.lit(x) for k, v in RULES.items() for x in (k, v[i]) if v[i] is not None))[F.col("rule")].cast(kind)
    out = observed.withColumns({"area": field(0, "string"), "severity": field(1, "string"), "most": field(2, "double")})
    return out.withColumn("failed", F.when(F.col("most").isNull(), F.col("observed") < LEAST_ROWS).otherwise(F.col("observed") > F.col("most")).cast("int"))


def rules(m: Decisions) -> DataFrame:
    """Every rule's observed value, one aggregate for each table."""
    m.keep("zone_day", "ranking")
    bad = lambda c: count_if(c)
    keys = m.node_state.groupBy("ts", "zone_id", "station_id", "feeder_id").agg(F.count(F.lit(1)).alias("n"))
    storage = ratio("storage_cover_mw", "demand_mw")
    pressed = known(ratio("ev_alloc_mw", "demand_mw") > MOST_RATIO, False) | known(storage > MOST_RATIO, False)
    parts = [
        _one(m.frame("demand"), row_count_demand=F.count(F.lit(1)), null_zone=bad(F.col("zone_id").isNull()), null_time=bad(F.col("ts").isNull()), null_demand=bad(F.col("demand_mw").isNull())),
        _one(keys, duplicates_node_hour=bad(F.col("n") > 1)),
        _one(m.node_state, negative_demand=bad(F.col("demand_mw") < 0), capacity_not_positive=bad(F.col("capacity_mw") <= 0), overload_share=F.avg(F.when(F.col("load_ratio") > 1.0, 1).otherwise(0)), ratios_out_of_range=bad(pressed)),
        _one(m.frame("congestion").select("ts_start", "ts_end").unionByName(m.frame("outages").select("ts_start", "ts_end")), times_reversed=bad(F.col("ts_end") < F.col("ts_start"))),
        _one(m.outage_overlaps, flagged_without_overlap=bad(F.col("congestion_flag") & ~F.col("overlap_flag"))),
        _one(m.frame("generation"), curtailment_over_generation=bad(F.col("curtailment_mw") > F.col("generation_mw"))),
        _one(m.zone_month.join(m.ranking.select("zone_id"), "zone_id", "left_anti"), zones_without_score=F.count(F.lit(1))),
        _one(m.ranking, scores_out_of_range=bad(out_of_range()), tier_mismatch=bad(wrong_tier()), critical_without_action=bad((F.col("tier") == "critico") & (F.col("intervention") == "monitorizar"))),
        _one(_deferrable(m), deferrable_over_grid=bad(F.col("deferrable_capex") > F.col("capex_grid"))),
    ]
    return _judged(reduce(DataFrame.unionByName, parts))


_tier_sql = " OR ".join(f"({'true' if lo is None else f'priority >= {lo}'} AND {'true' if hi is None else f'priority < {hi}'} AND tier <> '{t}')" for t, (lo, hi) in TIERS.items())
_out_sql = " OR ".join(f"{c} NOT BETWEEN 0 AND 100" for c in (*SCORES, "priority"))
OBSERVED = {
    "row_count_demand": "count(*) FROM demand",
    "duplicates_node_hour": "count(*) FROM (SELECT 1 FROM node_state GROUP BY ts, zone_id, station_id, feeder_id HAVING count(*) > 1)",
    "null_zone": "count_if(zone_id IS NULL) FROM demand",
    "null_time": "count_if(ts IS NULL) FROM demand",
    "null_demand": "count_if(demand_mw IS NULL) FROM demand",
    "negative_demand": "count_if(demand_mw < 0) FROM node_state",
    "capacity_not_positive": "count_if(capacity_mw <= 0) FROM node_state",
    "times_reversed": "count_if(ts_end < ts_start) FROM (SELECT ts_start, ts_end FROM congestion UNION ALL SELECT ts_start, ts_end FROM outages)",
    "overload_share": "coalesce(avg(CASE WHEN load_ratio > 1 THEN 1 ELSE 0 END), 0) FROM node_state",
    "flagged_without_overlap": "count_if(congestion_flag AND NOT overlap_flag) FROM outage_overlaps",
    "curtailment_over_generation": "count_if(curtailment_mw > generation_mw) FROM generation",
    "zones_without_score": "count(*) FROM zone_month ANTI JOIN ranking USING (zone_id)",
    "ratios_out_of_range": f"count_if(coalesce(ev_alloc_mw / nullif(demand_mw, 0) > {MOST_RATIO}, false) OR coalesce(storage_cover_mw / nullif(demand_mw, 0) > {MOST_RATIO}, false)) FROM node_state",
    "scores_out_of_range": f"count_if({_out_sql}) FROM ranking",
    "tier_mismatch": f"count_if({_tier_sql}) FROM ranking",
    "deferrable_over_grid": f"count_if(deferrable_capex > capex_grid) FROM ({DEFERRABLE})",
    "critical_without_action": "count_if(tier = 'critico' AND intervention = 'monitorizar') FROM ranking",
}
RULES_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS rule, '{area}' AS area, '{severity}' AS severity, CAST(o AS DOUBLE) AS observed, {'NULL::DOUBLE' if most is None else f'{most}::DOUBLE'} AS most, CAST({f'o < {LEAST_ROWS}' if most is None else f'o > {most}::DOUBLE'} AS INTEGER) AS failed FROM (SELECT {OBSERVED[k].replace(' FROM ', ' AS o FROM ', 1)})"
    for k, (area, severity, most) in RULES.items())


def output_gates(scoring: DataFrame, ranking: DataFrame, impacts: DataFrame, summary: DataFrame, detected: DataFrame, told: DataFrame, benchmark: DataFrame, sensitivity: DataFrame) -> DataFrame:
    """Gates across written outputs: what several of them say must agree.

    ``scoring``: ``zone_id, priority``; ``ranking``: ``zone_id, rank``; ``impacts``: ``scenario, cost``; ``summary``: the same, summed;
    ``detected``: ``anomaly_type``; ``told``: ``anomaly_type, n``; ``benchmark``: ``task``; ``sensitivity``: ``zone_id, rank`` of other weights.
    """
    by_score = scoring.orderBy(round_away("priority", 6).desc(), "zone_id").limit(1).select("zone_id")
    by_rank = ranking.orderBy("rank", "zone_id").limit(1).select("zone_id")
    agrees = by_score.join(by_rank, "zone_id", "full").agg((F.greatest(F.count(F.lit(1)), F.lit(1)) - 1).cast("double").alias("observed"))  # the same zone is one row, two zones are two
    costs = impacts.groupBy("scenario").agg(F.sum("cost").alias("own")).join(summary.select("scenario", "cost"), "scenario").agg(known(F.max(F.abs(F.col("own") - F.col("cost")))).alias("observed"))
    seen = detected.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("seen"))
    counts = seen.join(told.select("anomaly_type", "n"), "anomaly_type", "full").agg(known(count_if(known("n", 0) != known("seen", 0)).cast("double")).alias("observed"))
    moved = sensitivity.select("zone_id", F.col("rank").alias("other")).join(ranking.select("zone_id", "rank"), "zone_id").agg(known(F.max(F.abs(F.col("rank") - F.col("other"))).cast("double")).alias("observed"))
    covered = benchmark.select("task").distinct().where(F.col("task").isin(*TASK_NAMES)).agg((F.lit(len(TASK_NAMES)) - F.count(F.lit(1))).cast("double").alias("observed"))
    empty = lambda df: df.limit(1).agg((F.lit(1) - F.count(F.lit(1))).cast("double").alias("observed"))
    named = [
        ("scoring_filled", True, 0.0, empty(scoring)), ("scenarios_filled", True, 0.0, empty(summary)), ("anomalies_filled", False, 0.0, empty(detected)), ("benchmark_filled", False, 0.0, empty(benchmark)), ("sensitivity_filled", False, 0.0, empty(sensitivity)),
        ("ranking_matches_scoring_top", True, 0.0, agrees), ("scenario_cost_consistency", True, 1e-6, costs), ("anomaly_summary_consistency", False, 0.0, counts), ("score_stability_rank_shift", False, float(MOST_SHIFT), moved), ("forecast_required_tasks_covered", False, 0.0, covered),
    ]
    parts = [df.select(F.lit(n).alias("gate"), F.lit(int(blocker)).alias("blocker"), "observed", (F.col("observed") <= most).cast("int").alias("passed")) for n, blocker, most, df in named]
    return reduce(DataFrame.unionByName, parts)


def gates(m: Decisions) -> DataFrame:
    """The gates over this run's outputs, each as it was written."""
    m.keep("anomalies", "precursors", "ranking", "ranking_table", "scores", "scenario_summary", "task_benchmark")
    told = m.precursors.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"))
    return output_gates(m.ranking, m.ranking_table, m.scenarios, m.scenario_summary, m.anomalies, told, m.task_benchmark, m.sensitivity)


_ranked = "SELECT zone_id, row_number() OVER (ORDER BY round(priority, 6) DESC, zone_id) AS rank FROM ranking"
_shifted = "SELECT s.zone_id, row_number() OVER (PARTITION BY f.factor ORDER BY {alternative} DESC, s.zone_id) AS other FROM scores s CROSS JOIN (VALUES (0.9::DOUBLE), (1.1::DOUBLE)) f(factor)"


def _gates_sql() -> str:
    from gridloom.operators.scoring import URGENCY

    moved = list(URGENCY)[:2]
    alternative = " + ".join(f"{w!r}::DOUBLE * {'factor * ' if s in moved else ''}{s}" for s, w in URGENCY.items())
    empty = lambda t: f"SELECT 1 - count(*) FROM (SELECT 1 FROM {t} LIMIT 1)"
    named = [
        ("scoring_filled", 1, 0, empty("ranking")), ("scenarios_filled", 1, 0, empty("scenario_summary")), ("anomalies_filled", 0, 0, empty("anomalies")), ("benchmark_filled", 0, 0, empty("task_benchmark")), ("sensitivity_filled", 0, 0, empty("scores")),
        ("ranking_matches_scoring_top", 1, 0, f"SELECT count(*) FROM ({_ranked}) WHERE rank = 1 AND zone_id NOT IN (SELECT zone_id FROM (SELECT zone_id FROM ranking ORDER BY round(priority, 6) DESC, zone_id LIMIT 1))"),
        ("scenario_cost_consistency", 1, 1e-6, "SELECT coalesce(max(abs(own - cost)), 0) FROM (SELECT scenario, sum(cost) AS own FROM scenarios GROUP BY 1) JOIN scenario_summary USING (scenario)"),
        ("anomaly_summary_consistency", 0, 0, "SELECT count_if(coalesce(a.n, 0) <> coalesce(b.n, 0)) FROM (SELECT anomaly_type, count(*) AS n FROM anomalies GROUP BY 1) a FULL JOIN (SELECT anomaly_type, count(*) AS n FROM precursors GROUP BY 1) b USING (anomaly_type)"),
        ("score_stability_rank_shift", 0, MOST_SHIFT, f"SELECT coalesce(max(abs(rank - other)), 0) FROM ({_shifted.format(alternative=alternative)}) JOIN ({_ranked}) USING (zone_id)"),
        ("forecast_required_tasks_covered", 0, 0, f"SELECT {len(TASK_NAMES)} - count(DISTINCT task) FROM task_benchmark WHERE task IN {TASK_NAMES}"),
    ]
    return " UNION ALL ".join(f"SELECT '{n}' AS gate, {b} AS blocker, CAST(o AS DOUBLE) AS observed, CAST(o <= {most}::DOUBLE AS INTEGER) AS passed FROM (SELECT ({q}) AS o)" for n, b, most, q in named)


GATES_SQL = _gates_sql()


def assessment(issues: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: findings by severity, status, confidence and the five states, from rules (``severity``, ``failed``) and gates (``blocker``, ``passed``)."""
    of = lambda s: F.coalesce(count_if((F.col("severity") == s) & (F.col("failed") == 1)), F.lit(0))
    found = issues.agg(of("alta").alias("n_high"), of("media").alias("n_med"), of("baja").alias("n_low"))
    blocked = checks.agg(F.coalesce(count_if((F.col("blocker") == 1) & (F.col("passed") == 0)), F.lit(0)).alias("n_blocked"))
    out = found.crossJoin(F.broadcast(blocked))  # one row each
    high, med = F.col("n_high") > 0, F.col("n_med") > 0
    state = F.when(high | (F.col("n_blocked") > 0), "blocked").when(F.col("n_med") >= 2, "several").when(F.col("n_med") == 1, "one").otherwise("none")
    out = out.withColumns({"status": F.when(high, "FAIL").when(med, "WARN").otherwise("PASS"), "confidence": F.when(high, "baja").when(med, "media").otherwise("alta"), "state": state})
    return out.withColumns({f"{name}_state": F.create_map(*(F.lit(x) for k, v in READINESS.items() for x in (k, v[i])))[F.col("state")] for i, name in enumerate(STATES)})


_states = ", ".join(f"CASE state {' '.join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in READINESS.items())} END AS {name}_state" for i, name in enumerate(STATES))
READY_SQL = (f"SELECT *, {_states} FROM (SELECT *, CASE WHEN n_high > 0 THEN 'FAIL' WHEN n_med > 0 THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN n_high > 0 THEN 'baja' WHEN n_med > 0 THEN 'media' ELSE 'alta' END AS confidence, "
             "CASE WHEN n_high > 0 OR n_blocked > 0 THEN 'blocked' WHEN n_med >= 2 THEN 'several' WHEN n_med = 1 THEN 'one' ELSE 'none' END AS state "
             "FROM (SELECT count_if(severity = 'alta' AND failed = 1) AS n_high, count_if(severity = 'media' AND failed = 1) AS n_med, count_if(severity = 'baja' AND failed = 1) AS n_low "
             f"FROM ({RULES_SQL})) CROSS JOIN (SELECT count_if(blocker = 1 AND passed = 0) AS n_blocked FROM ({GATES_SQL})))")


def release(m: Decisions) -> DataFrame:
    """All that a release must pass: the data checks by severity, then the gates across outputs, blocking ones and others."""
    by = checks(m).select("severity", (F.col("observed") > 0).cast("int").alias("bad")).unionByName(gates(m).select(F.when(F.col("blocker") == 1, "gate_blocker").otherwise("gate_warning").alias("severity"), (F.lit(1) - F.col("passed")).alias("bad")))
    out = by.groupBy("severity").agg(F.count(F.lit(1)).alias("checks"), F.sum("bad").alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "PASS").when(F.col("severity").isin("alta", "gate_blocker"), "FAIL").otherwise("WARN"))


RELEASE_SQL = (f"SELECT *, CASE WHEN failed = 0 THEN 'PASS' WHEN severity IN ('alta', 'gate_blocker') THEN 'FAIL' ELSE 'WARN' END AS status FROM (SELECT severity, count(*) AS checks, sum(bad) AS failed FROM "
               f"(SELECT severity, CAST(observed > 0 AS INTEGER) AS bad FROM ({CHECKS_SQL}) UNION ALL SELECT CASE WHEN blocker = 1 THEN 'gate_blocker' ELSE 'gate_warning' END, 1 - passed FROM ({GATES_SQL})) GROUP BY 1)")

# Profiles

#: Key columns of each role.
KEYS = {
    "zones": ("zone_id",), "substations": ("station_id",), "feeders": ("feeder_id",), "demand": ("ts", "zone_id", "station_id", "feeder_id"), "generation": ("ts", "zone_id", "technology"), "ev": ("ts", "zone_id", "charging_type"),
    "industry": ("ts", "zone_id", "cluster"), "congestion": ("event_id",), "outages": ("outage_id",), "assets": ("asset_id",), "flexibility": ("resource_id",), "storage": ("storage_id",), "interventions": ("intervention_id",), "investments": ("investment_id",), "macro": ("day_no", "scenario"),
}
#: The column of time whose first and last value a table covers.
TIMES = {"demand": "ts", "generation": "ts", "ev": "ts", "industry": "ts", "congestion": "ts_start", "outages": "ts_start"}
COLUMNS = {role: [("day_no" if c == "day" else c) for c in names.values()] for role, (_, names) in FRAMES.items()}
#: Numeric columns, whose distribution is shown.
NUMERIC = {
    "zones": ("criticality", "climate_risk", "growth_tension"), "substations": ("capacity_mw", "firm_mw", "age_years"), "feeders": ("capacity_mw", "climate_exposure"), "demand": ("demand_mw", "temperature", "voltage"), "generation": ("generation_mw", "curtailment_mw"),
    "ev": ("ev_mw",), "industry": ("industry_mw",), "congestion": ("energy_mwh",), "outages": ("customers", "ens_mwh"), "assets": ("age_years", "health", "failure_p", "capex"), "flexibility": ("flex_mw", "cost_eur_mwh"), "storage": ("energy_mwh", "power_mw"),
    "interventions": ("relief_mw", "cost", "days"), "investments": ("capex", "horizon_months"), "macro": ("growth_index",),
}
#: Columns of names, whose distinct values are counted.
NAMES = {"zones": ("zone_type", "region"), "feeders": ("grid_type",), "demand": ("day_type",), "generation": ("technology",), "congestion": ("severity",), "outages": ("severity",), "assets": ("asset_type",), "investments": ("investment_type",), "macro": ("scenario",)}


def _every(m: Decisions, part: Callable[[str, DataFrame], DataFrame], roles) -> DataFrame:
    return reduce(DataFrame.unionByName, [part(r, m.frame(r)) for r in roles])


def summary(m: Decisions) -> DataFrame:
    """Rows, columns, keys that are null or repeated, covered time and the highest share of nulls of each table."""

    def part(role: str, df: DataFrame) -> DataFrame:
        nulls = {c: count_if(F.col(c).isNull()) for c in COLUMNS[role]}
        no_key = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in KEYS[role]))
        at = F.date_format(F.col(TIMES[role]), "yyyy-MM-dd HH:mm:ss") if role in TIMES else F.lit(None).cast("string")
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), known(count_if(no_key), 0).alias("null_keys"), F.min(at).alias("first"), F.max(at).alias("last"), *(known(v, 0).alias(f"n_{c}") for c, v in nulls.items()))
        one = one.withColumn("null_rate", known(F.greatest(*(ratio(f"n_{c}", "n_rows") for c in nulls), F.lit(0.0))))
        twice = df.groupBy(*KEYS[role]).agg(F.count(F.lit(1)).alias("n")).agg(known(F.sum(F.col("n") - 1), 0).alias("repeated_keys"))
        return one.crossJoin(F.broadcast(twice)).select(F.lit(role).alias("table_name"), "n_rows", F.lit(len(nulls)).alias("n_columns"), "null_keys", "repeated_keys", "first", "last", "null_rate")  # one row each

    return _every(m, part, KEYS)


def _summary_sql() -> str:
    out = []
    for role, keys in KEYS.items():
        no_key = " OR ".join(f"{c} IS NULL" for c in keys)
        rate = ", ".join(f"count_if({c} IS NULL) / nullif(count(*), 0)" for c in COLUMNS[role])
        at = f"strftime({TIMES[role]}, '%Y-%m-%d %H:%M:%S')" if role in TIMES else "NULL::VARCHAR"
        out.append(f"SELECT '{role}' AS table_name, count(*) AS n_rows, {len(COLUMNS[role])} AS n_columns, count_if({no_key}) AS null_keys, (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {role} GROUP BY {', '.join(keys)})) AS repeated_keys, min({at}) AS first, max({at}) AS last, coalesce(greatest({rate}, 0), 0) AS null_rate FROM {role}")
    return " UNION ALL ".join(out)


def nulls(m: Decisions) -> DataFrame:
    """Nulls of every column of every table, one aggregate a table."""

    def part(role: str, df: DataFrame) -> DataFrame:
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), *(known(count_if(F.col(c).isNull()), 0).alias(c) for c in COLUMNS[role]))
        rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in COLUMNS[role])))
        return one.select(F.lit(role).alias("table_name"), "n_rows", rows.alias("r")).select("table_name", "n_rows", "r.*").withColumn("null_rate", ratio("nulls", "n_rows"))

    return _every(m, part, COLUMNS)


NULLS_SQL = " UNION ALL ".join(f"SELECT '{r}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count_if({c} IS NULL) AS nulls, count_if({c} IS NULL) / nullif(count(*), 0) AS null_rate FROM {r}" for r, cs in COLUMNS.items() for c in cs)


def distributions(m: Decisions) -> DataFrame:
    """Least, middle, 95th percentile, largest and mean value of the numeric columns."""

    def long(role: str, df: DataFrame) -> DataFrame:
        rows = F.explode(F.array(*(F.struct(F.lit(f"{role}.{c}").alias("column_name"), F.col(c).cast("double").alias("value")) for c in NUMERIC[role])))
        return df.select(rows.alias("r")).select("r.*")

    def plain(role: str, df: DataFrame) -> DataFrame:
        one = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in NUMERIC[role] for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg))))
        return one.select(F.explode(F.array(*(F.struct(F.lit(f"{role}.{c}").alias("column_name"), *(F.col(f"{c}_{n}").alias(n) for n in ("low", "high", "mean"))) for c in NUMERIC[role]))).alias("r")).select("r.*")

    values = m.once(_every(m, long, NUMERIC), "values")
    return _every(m, plain, NUMERIC).join(quantiles(values, ["column_name"], "value", {"middle": 0.5, "p95": 0.95}, m.once), "column_name", "left")


DISTRIBUTIONS_SQL = " UNION ALL ".join(f"SELECT '{r}.{c}' AS column_name, min({c}::DOUBLE) AS low, quantile_cont({c}::DOUBLE, 0.5) AS middle, quantile_cont({c}::DOUBLE, 0.95) AS p95, max({c}::DOUBLE) AS high, avg({c}::DOUBLE) AS mean FROM {r}" for r, cs in NUMERIC.items() for c in cs)


def cardinality(m: Decisions) -> DataFrame:
    """Distinct values of the columns of names, with the three most frequent."""

    def long(role: str, df: DataFrame) -> DataFrame:
        rows = F.explode(F.array(*(F.struct(F.lit(f"{role}.{c}").alias("column_name"), F.col(c).cast("string").alias("value")) for c in NAMES[role])))
        return df.select(rows.alias("r")).select("r.*").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))

    n = _every(m, long, NAMES).withColumn("place", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value")))
    told = F.when(F.col("place") <= 3, F.struct("place", F.concat_ws(":", "value", F.col("n").cast("string")).alias("t")))
    return n.groupBy("column_name").agg(F.count("value").alias("n_values"), F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["t"]), "; ").alias("top"))


CARDINALITY_SQL = ("SELECT column_name, count(value) AS n_values, string_agg(CASE WHEN place <= 3 THEN concat_ws(':', value, n) END, '; ' ORDER BY place) AS top FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS place FROM ("
                   + " UNION ALL ".join(f"SELECT '{r}.{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {r} GROUP BY 2" for r, cs in NAMES.items() for c in cs) + ")) GROUP BY 1")

#: Table, rule, condition of a failing row in Spark's and DuckDB's common SQL; a rule named in ``GRAVE`` is of the first priority.
TABLE_RULES = [
    ("substations", "firm_over_capacity", "firm_mw > capacity_mw"),
    ("feeders", "base_load_over_capacity", "base_load_mw > capacity_mw * 1.2"),
    ("demand", "hour_differs_from_time", "hour(ts) <> hour_of_day"),
    ("demand", "month_differs_from_time", "month(ts) <> month_of_year"),
    ("demand", "impossible_figures", "demand_mw < 0 OR reactive_mw < 0"),
    ("generation", "self_use_over_generation", "self_use_mw > generation_mw + 0.000001"),
    ("generation", "negative_spill_or_curtailment", "spill_mw < 0 OR curtailment_mw < 0"),
    ("generation", "curtailment_over_spill", "curtailment_mw > spill_mw + 0.000001"),
    ("congestion", "end_before_start", "ts_end < ts_start"),
    ("congestion", "energy_or_ratio_invalid", "energy_mwh <= 0 OR max_ratio < 1"),
    ("outages", "end_before_start", "ts_end < ts_start"),
    ("outages", "customers_or_energy_invalid", "customers <= 0 OR ens_mwh < 0"),
    ("flexibility", "shares_out_of_range", "availability NOT BETWEEN 0 AND 1 OR reliability NOT BETWEEN 0 AND 1 OR maturity NOT BETWEEN 0 AND 1"),
    ("storage", "shares_out_of_range", "availability NOT BETWEEN 0 AND 1 OR efficiency NOT BETWEEN 0 AND 1"),
    ("investments", "shares_out_of_range", "ease NOT BETWEEN 0 AND 1 OR resilience NOT BETWEEN 0 AND 1 OR risk_reduction NOT BETWEEN 0 AND 1"),
    # four more than the domain's own fifteen
    ("generation", "curtailment_over_generation", "curtailment_mw > generation_mw + 0.000001"),
    ("ev", "negative_ev", "ev_mw < 0"),
    ("industry", "negative_industry", "industry_mw < 0"),
    ("assets", "shares_out_of_range", "failure_p NOT BETWEEN 0 AND 1 OR criticality NOT BETWEEN 0 AND 1"),
]
GRAVE = ("end_before_start", "impossible_figures")
# Shares of hours over capacity, and of flagged outages without an event, beyond which a finding is raised.
OVER_CAPACITY, UNMATCHED = 0.35, 0.2


def table_rules(m: Decisions) -> DataFrame:
    """Failing rows of every rule, one aggregate for each table."""

    def part(role: str, df: DataFrame) -> DataFrame:
        mine = [(n, c) for t, n, c in TABLE_RULES if t == role]
        one = df.agg(*(known(count_if(F.expr(c)), 0).alias(n) for n, c in mine))
        return one.select(F.explode(F.array(*(F.struct(F.lit(role).alias("table_name"), F.lit(n).alias("rule"), F.col(n).alias("failed")) for n, _ in mine))).alias("r")).select("r.*")

    return _every(m, part, list(dict.fromkeys(t for t, _, _ in TABLE_RULES)))


TABLE_RULES_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{n}' AS rule, count_if({c}) AS failed FROM {t}" for t, n, c in TABLE_RULES)


def cross(m: Decisions) -> DataFrame:
    """Checks across tables: hours over capacity, flagged outages that meet no event, and how congestion and unserved energy of substations go together."""
    d = m.frame("demand").join(m.frame("feeders").select("feeder_id", "capacity_mw"), "feeder_id")
    capacity = d.agg(known(F.avg(F.when(F.col("demand_mw") > F.col("capacity_mw"), 1.0).otherwise(0.0))).alias("value")).withColumn("name", F.lit("over_capacity_rate"))
    highest = d.agg(F.max(ratio("demand_mw", "capacity_mw")).alias("value")).withColumn("name", F.lit("max_load_ratio"))
    flagged = m.frame("outages").where("congestion_flag")
    met = overlapping_ids(flagged, m.frame("congestion"), "station_id", "outage_id").agg(F.count(F.lit(1)).alias("met"))
    alone = flagged.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(met)).select(known(ratio(F.col("n") - F.col("met"), "n")).alias("value"), F.lit("unmatched_outage_rate").alias("name"))  # one row each
    c = m.frame("congestion").groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    e = m.frame("outages").groupBy("station_id").agg(F.sum("ens_mwh").alias("ens"))
    going = c.join(e, "station_id").agg(F.corr(F.col("n").cast("double"), F.col("ens").cast("double")).alias("value")).withColumn("name", F.lit("congestion_ens_correlation"))
    return reduce(DataFrame.unionByName, [capacity, highest, alone, going]).select("name", "value")


CROSS_SQL = ("SELECT 'over_capacity_rate' AS name, coalesce(avg(CASE WHEN d.demand_mw > f.capacity_mw THEN 1.0 ELSE 0.0 END), 0) AS value FROM demand d JOIN feeders f USING (feeder_id) "
             "UNION ALL SELECT 'max_load_ratio', max(d.demand_mw / nullif(f.capacity_mw, 0)) FROM demand d JOIN feeders f USING (feeder_id) "
             "UNION ALL SELECT 'unmatched_outage_rate', coalesce((count(*) - count_if(outage_id IN (SELECT o.outage_id FROM outages o JOIN congestion c ON c.station_id = o.station_id AND c.ts_start <= o.ts_end AND c.ts_end >= o.ts_start))) / nullif(count(*), 0), 0) FROM outages WHERE congestion_flag "
             "UNION ALL SELECT 'congestion_ens_correlation', corr(n::DOUBLE, ens::DOUBLE) FROM (SELECT station_id, count(*) AS n FROM congestion GROUP BY 1) JOIN (SELECT station_id, sum(ens_mwh) AS ens FROM outages GROUP BY 1) USING (station_id)")


def issues(m: Decisions) -> DataFrame:
    """The profile's findings by priority: keys first, then rules of a table, checks across tables, and what always holds."""
    s = m.once(summary(m), "summary")
    key = lambda column, kind: s.where(F.col(column) > 0).select(F.lit("P1").alias("priority"), F.lit(kind).alias("kind"), F.col("table_name").alias("scope"), F.lit("").alias("rule"), F.col(column).cast("double").alias("observed"))
    broken = table_rules(m).where("failed > 0").select(F.when(F.col("rule").isin(*GRAVE), "P1").otherwise("P2").alias("priority"), F.lit("logic").alias("kind"), F.col("table_name").alias("scope"), "rule", F.col("failed").cast("double").alias("observed"))
    beyond = F.when(F.col("name") == "over_capacity_rate", F.col("value") > OVER_CAPACITY).when(F.col("name") == "unmatched_outage_rate", F.col("value") > UNMATCHED).otherwise(False)
    crossed = cross(m).where(beyond).select(F.lit("P2").alias("priority"), F.lit("across tables").alias("kind"), F.lit("").alias("scope"), F.col("name").alias("rule"), F.col("value").alias("observed"))
    always = m.spark.createDataFrame([("P3", "redundant", "demand", "derived_columns", None), ("P3", "modelling", "macro", "daily_grain", None)], "priority string, kind string, scope string, rule string, observed double")
    return reduce(DataFrame.unionByName, [key("null_keys", "null key"), key("repeated_keys", "repeated key"), broken, crossed, always])


ISSUES_SQL = (f"WITH s AS ({_summary_sql()}) SELECT 'P1' AS priority, 'null key' AS kind, table_name AS scope, '' AS rule, null_keys::DOUBLE AS observed FROM s WHERE null_keys > 0 UNION ALL SELECT 'P1', 'repeated key', table_name, '', repeated_keys::DOUBLE FROM s WHERE repeated_keys > 0 "
              f"UNION ALL SELECT CASE WHEN rule IN {GRAVE} THEN 'P1' ELSE 'P2' END, 'logic', table_name, rule, failed::DOUBLE FROM ({TABLE_RULES_SQL}) WHERE failed > 0 "
              f"UNION ALL SELECT 'P2', 'across tables', '', name, value FROM ({CROSS_SQL}) WHERE (name = 'over_capacity_rate' AND value > {OVER_CAPACITY}::DOUBLE) OR (name = 'unmatched_outage_rate' AND value > {UNMATCHED}::DOUBLE) "
              "UNION ALL SELECT 'P3', 'redundant', 'demand', 'derived_columns', NULL::DOUBLE UNION ALL SELECT 'P3', 'modelling', 'macro', 'daily_grain', NULL::DOUBLE")

MORE = f"{ALL},\n{TASKS}" if TASKS not in ALL else ALL

QUERIES = [
    Query("dq_rules", "rule area severity ~observed ~most failed", rules, RULES_SQL, more=ALL),
    Query("dq_output_gates", "gate #blocker ~observed #passed", gates, GATES_SQL, more=MORE),
    Query("dq_readiness", "#n_high #n_med #n_low #n_blocked status confidence " + " ".join(f"{s}_state" for s in STATES), lambda m: assessment(rules(m), gates(m)), READY_SQL, more=MORE),
    Query("dq_release_gates_all", "severity #checks #failed status", release, RELEASE_SQL, more=MORE),
    Query("profile_summary", "table_name #n_rows #n_columns #null_keys #repeated_keys first last ~null_rate:6", summary, _summary_sql()),
    Query("profile_nulls", "table_name column_name #n_rows #nulls ~null_rate:6", nulls, NULLS_SQL),
    Query("profile_distributions", "column_name ~low ~middle ~p95 ~high ~mean", distributions, DISTRIBUTIONS_SQL),
    Query("profile_cardinality", "column_name #n_values top", cardinality, CARDINALITY_SQL),
    Query("profile_rules", "table_name rule #failed", table_rules, TABLE_RULES_SQL),
    Query("profile_cross", "name ~value", cross, CROSS_SQL),
    Query("profile_issues", "priority kind scope rule ~observed", issues, ISSUES_SQL),
]
