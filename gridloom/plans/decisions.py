"""Anomalies, forecasts, scores and scenarios over the marts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import known, round_away
from gridloom.operators import anomalies, forecasting, scoring
from gridloom.operators.ranking import numbered
from gridloom.plans.marts import Marts
from gridloom.sources import stages


class Decisions(Marts):
    """The marts with all that is decided on them."""

    def __init__(self, *args, **named):
        super().__init__(*args, **named)
        self._given: set[str] = set()

    # forecasts

    @cached_property
    def zone_series(self) -> DataFrame:
        """Daily demand of each zone: the series of the task ``demanda_zona``."""
        self.keep("day_series")
        kind = self.frame("zones").schema["zone_id"].dataType
        return self.day_series.where("series.task = 'demanda_zona'").select(F.col("series.entity").cast(kind).alias("zone_id"), "day", F.col("value").alias("demand"))

    @cached_property
    def region_series(self) -> DataFrame:
        """Daily demand of each region, under its name."""
        regions = self.frame("zones").select("zone_id", "region")
        return self.zone_series.join(regions, "zone_id").groupBy(F.col("region").alias("zone_id"), "day").agg(F.sum("demand").alias("demand"))

    @cached_property
    def forecasts(self) -> DataFrame:
        """Held-out days of the zones' and the regions' demand, both in one back-test: ``task, entity, day, actual`` and a column a model."""
        self.keep("zone_series")
        one = lambda task, df: df.select(F.struct(F.lit(task).alias("task"), F.col("zone_id").cast("string").alias("entity")).alias("series"), "day", "demand")
        both = one("demanda_zona", self.zone_series).unionByName(one("demanda_region", self.region_series))
        return forecasting.backtest(both, "series", "day", "demand").select("series.*", "day", "actual", *forecasting.MODELS)

    @cached_property
    def zone_forecast(self) -> DataFrame:
        self.keep("forecasts")
        kind = self.frame("zones").schema["zone_id"].dataType
        return self.forecasts.where("task = 'demanda_zona'").select(F.col("entity").cast(kind).alias("zone_id"), "day", "actual", *forecasting.MODELS)

    @cached_property
    def errors(self) -> DataFrame:
        """A row for each task, held-out day and model."""
        self.keep("forecasts")
        return forecasting.by_model(self.forecasts.withColumnRenamed("entity", "zone_id"), ["task", "zone_id", "day"])

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.errors.groupBy("task", "model").agg(*forecasting.metrics(), F.count(F.lit(1)).alias("n"))

    @cached_property
    def winners(self) -> DataFrame:
        """The model of least mean absolute error of each task; the first by name among equals."""
        return self.benchmark.groupBy("task").agg(F.min_by(F.struct("model", "mae"), F.struct(F.round("mae", 9), "model")).alias("b")).select("task", "b.model", "b.mae")

    @cached_property
    def best_zone_errors(self) -> DataFrame:
        best = self.winners.where("task = 'demanda_zona'").select("model")
        kind = self.frame("zones").schema["zone_id"].dataType
        return self.errors.where("task = 'demanda_zona'").join(best, "model", "left_semi").withColumn("zone_id", F.col("zone_id").cast(kind))

    @cached_property
    def predictability(self) -> DataFrame:
        self.keep("zone_day")
        pressure = self.zone_day.groupBy("zone_id").agg(F.avg("ev_mwh").alias("ev_mean"), F.avg("industry_mwh").alias("industry_mean"), F.avg("demand_mwh").alias("demand_mean"))
        return forecasting.predictability(self.best_zone_errors, pressure, "zone_id")

    # forecasts of the marts' own series

    @cached_property
    def day_series(self) -> DataFrame:
        """Daily values of the five tasks, by ``series`` (task, entity): the source's own, or else the marts'."""
        own = self.offered("series")
        if own is not None:
            return own.select(F.struct("task", F.col("entity").cast("string").alias("entity")).alias("series"), "day", F.col("value").cast("double").alias("value"))
        load = self.node_state.groupBy("zone_id", "day").agg(F.avg("load_ratio").alias("load_ratio"))
        zones = self.zone_day.select("zone_id", "day", "demand_mwh", "ev_mwh", "industry_mwh").join(load, ["zone_id", "day"], "left")
        tasks = {"demanda_zona": "demand_mwh", "carga_relativa_zona": "load_ratio", "demanda_ev_zona": "ev_mwh", "demanda_industrial_zona": "industry_mwh"}
        rows = F.explode(F.array(*(F.struct(F.lit(t).alias("task"), F.col(c).cast("double").alias("value")) for t, c in tasks.items())))
        by_zone = zones.select(F.col("zone_id").alias("entity"), "day", rows.alias("x")).select("x.task", "entity", "day", "x.value")
        stations = self.node_state.groupBy(F.col("station_id").alias("entity"), "day").agg(F.sum("demand_mw").cast("double").alias("value"))
        both = by_zone.unionByName(stations.withColumn("task", F.lit("demanda_subestacion")))
        return both.select(F.struct("task", F.col("entity").cast("string").alias("entity")).alias("series"), "day", "value")

    @cached_property
    def hour_series(self) -> DataFrame:
        """Hourly demand of each zone, and whether any of its nodes is at its peak hour: the source's own, or else the marts'."""
        own = self.offered("hours")
        if own is not None:
            return own
        return self.node_state.groupBy("zone_id", "ts").agg(F.sum("demand_mw").alias("value"), F.max("peak_flag").alias("peak"))

    @cached_property
    def day_forecast(self) -> DataFrame:
        self.keep("day_series")
        return forecasting.backtest(self.day_series, "series", "day", "value", **forecasting.DAILY).select("series.*", "day", "actual", *forecasting.MODELS)

    @cached_property
    def hour_forecast(self) -> DataFrame:
        self.keep("hour_series")
        held = forecasting.backtest(self.hour_series, "zone_id", "ts", "value", **forecasting.HOURLY)
        return held.join(self.hour_series.select("zone_id", "ts", "peak"), ["zone_id", "ts"])

    @cached_property
    def task_errors(self) -> DataFrame:
        return forecasting.by_model(self.day_forecast, ["task", "entity", "day"])

    @cached_property
    def task_benchmark(self) -> DataFrame:
        self.keep("task_errors")
        return self.task_errors.groupBy("task", "model").agg(*forecasting.metrics(), F.count(F.lit(1)).alias("n"))

    @cached_property
    def task_winners(self) -> DataFrame:
        return self.task_benchmark.groupBy("task").agg(F.min_by(F.struct("model", "mae"), F.struct(F.round("mae", 9), "model")).alias("b")).select("task", "b.model", "b.mae")

    @cached_property
    def zone_type_errors(self) -> DataFrame:
        """Errors of the best model of the zones' demand, by type of zone."""
        best = self.task_winners.where("task = 'demanda_zona'").select("model")
        types = self.frame("zones").select(F.col("zone_id").cast("string").alias("entity"), "zone_type")
        rows = self.task_errors.where("task = 'demanda_zona'").join(best, "model", "left_semi").join(types, "entity", "left")
        return rows.groupBy("zone_type").agg(*forecasting.metrics(), F.count(F.lit(1)).alias("n"))

    @cached_property
    def hour_peak_errors(self) -> DataFrame:
        """Errors of each model over peak hours and over all hours."""
        return forecasting.by_model(self.hour_forecast, ["zone_id", "ts", "peak"]).groupBy("model").agg(*forecasting.metrics(F.col("peak"), "_peak"), *forecasting.metrics(None, "_all"))

    @cached_property
    def zone_peak_errors(self) -> DataFrame:
        """The same for each zone on its own."""
        rows = forecasting.by_model(self.hour_forecast, ["zone_id", "ts", "peak"])
        return rows.groupBy("zone_id", "model").agg(*forecasting.metrics(F.col("peak"), "_peak"), *forecasting.metrics(None, "_all"), F.count(F.lit(1)).alias("n"))

    # anomalies

    DETECTORS = ("demand", "load", "curtailment", "ens", "station", "pattern")

    def detected(self, detector: str) -> DataFrame:
        """What one detector finds; ids that it has none of are null, in the source's own type."""
        self.keep("node_signals", "zone_day")
        n, z = self.node_signals, self.zone_day
        df = {
            "demand": lambda: anomalies.unexpected_demand(n), "load": lambda: anomalies.abnormal_load(n, once=self.once), "curtailment": lambda: anomalies.abnormal_curtailment(n, once=self.once),
            "ens": lambda: anomalies.atypical_ens(z), "station": lambda: anomalies.station_trend(n), "pattern": lambda: anomalies.off_pattern(n),
        }[detector]()
        return df.withColumns({c: F.col(c).cast(n.schema[c].dataType) for c in ("zone_id", "station_id", "feeder_id")})

    @cached_property
    def anomalies(self) -> DataFrame:
        return anomalies.union([self.detected(d) for d in self.DETECTORS])

    @cached_property
    def anomaly_ids(self) -> DataFrame:
        """The anomalies with ids in the order of their scores, then of time."""
        order = [round_away("score", 4, 1e-5).desc(), F.col("ts"), F.col("anomaly_type"), F.col("zone_id"), F.col("station_id").asc_nulls_first(), F.col("feeder_id").asc_nulls_first()]
        out = numbered(self.anomalies, order, lambda df: self.once(df, "anomalies_ordered"), "nth")
        return out.withColumn("anomaly_id", F.concat(F.lit("ANOM_"), F.lpad(F.col("nth").cast("string"), 7, "0")))

    @cached_property
    def precursors(self) -> DataFrame:
        self.keep("node_signals", "zone_day", "anomalies")
        return anomalies.with_precursors(self.anomalies, self.node_signals, self.zone_day)

    @cached_property
    def zone_intensity(self) -> DataFrame:
        self.keep("precursors")
        return anomalies.intensity(self.precursors, "zone_id")

    # inputs of the scores that an earlier stage may not have left

    def use(self, **given: DataFrame | str | None) -> Decisions:
        """Take the output of the stages ``forecast`` (see ``predictability``) and ``anomaly`` (``zone_intensity``) from a frame or a path instead of computing it.

        ``None``, or a path that isn't there, is a stage that has not run: its
        figures are 0 and its decision says so. Call it before anything is scored.
        """
        kind = self.frame("zones").schema["zone_id"].dataType
        for stage, source in given.items():
            layer = {"forecast": "predictability", "anomaly": "zone_intensity"}[stage]
            self.__dict__[layer] = stages.resolve(self.spark, stage, source, kind)
            self._given.add(layer)
        return self

    # scores

    @cached_property
    def score_base(self) -> DataFrame:
        by = "zone_id"
        self.keep("zone_day", "zone_month", "asset_exposure", "zone_risk", "flex_gap", "candidates", *({"zone_intensity", "predictability"} - self._given))
        months = self.zone_month_features.groupBy(by).agg(F.avg("congested_hours").alias("congested_hours"), F.avg("peak_mw").alias("peak_mw"), F.avg("resilience").alias("resilience"), F.avg("capex_intensity").alias("capex_intensity"), F.avg("growth_tension").alias("growth"), F.avg(F.col("ev_mwh") + F.col("industry_mwh")).alias("new_demand_mwh"))
        days = self.zone_day_features.groupBy(by).agg(F.avg("ens_mwh").alias("ens_mean"), F.avg("customers").alias("customers_mean"), F.avg("risk_cost").alias("risk_cost"), F.avg("unserved_mwh").alias("unserved_mwh"), F.avg("flex_gap_mwh").alias("flex_gap_mwh"))
        gap = self.flex_gap.select(by, "gap_mw", "economic_gap", "flex_ratio", F.col("congested_hours").alias("congested_total"))
        assets = self.asset_exposure.groupBy(by).agg(F.avg("exposure_score").alias("exposure"), F.avg("adjusted_p").alias("adjusted_p"), F.sum("station_ens_mwh").alias("exposed_ens"))
        invest = self.candidates.groupBy(by).agg(F.avg("capex").alias("capex_mean"), F.sum("capex").alias("capex_total"), F.avg("horizon_months").alias("mean_horizon"))
        forecast = self.predictability.select(by, "mae", "new_ratio", "decision")
        out = months
        for part in (days, gap, assets, invest, self.zone_intensity.select(by, "mean_score", "critical", "congestion_share", "outage_share"), forecast):
            out = out.join(part, by, "left")
        figures = [c for c in out.columns if c not in (by, "decision")]
        return out.withColumns({c: known(F.col(c).cast("double")) for c in figures}).withColumn("decision", known("decision", "forecast_no_disponible"))

    @cached_property
    def scores(self) -> DataFrame:
        self.keep("score_base")
        return scoring.seven_scores(self.score_base)

    @cached_property
    def options(self) -> DataFrame:
        self.keep("scores")
        return scoring.options(self.scores)

    @cached_property
    def ranking(self) -> DataFrame:
        self.keep("scores")
        return scoring.priorities(self.scores, scoring.best_option(self.options))

    @cached_property
    def ranking_table(self) -> DataFrame:
        """The ranking as it is written out beside the scores: zones in the order of their priority, a row for each."""
        self.keep("ranking")
        place = F.row_number().over(Window.orderBy(round_away("priority", 6).desc(), "zone_id"))
        return self.ranking.select("zone_id", "priority", "tier", place.alias("rank"))

    @cached_property
    def sensitivity(self) -> DataFrame:
        self.keep("scores")
        return scoring.sensitivity(self.scores)

    @cached_property
    def scenarios(self) -> DataFrame:
        self.keep("ranking")
        base = self.zone_month_features.groupBy("zone_id").agg(F.avg("curtailment_mwh").alias("curtailment_base"))
        return scoring.scenarios(self.ranking, base)

    @cached_property
    def month_measures(self) -> DataFrame:
        """Sums of a month and zone, and of a month, zone and type of the feeders' assets: what any filter of the board can be added up from.

        One pass over the feeder-hours by GROUPING SETS; a feeder's type is that
        of ``feeders``. Rows without ``asset_type`` and with ``of_type`` 0 are a zone's whole month.
        """
        self.keep("asset_exposure")
        kinds = self.asset_exposure.where("feeder_id IS NOT NULL").groupBy("feeder_id").agg(F.max("asset_type").alias("asset_type"))
        n = self.node_state.join(kinds, "feeder_id", "left").withColumn("month", F.date_trunc("month", "day"))
        sums = {
            "hours": F.count(F.lit(1)), "congested_hours": F.sum(F.col("congested").cast("int")), "high_hours": F.sum(F.col("high_load").cast("int")), "demand_mwh": F.sum("demand_mw"), "load_sum": F.sum("load_ratio"),
            "curtailment_mwh": F.sum("curtailment_alloc_mw"), "new_mwh": F.sum(F.col("ev_alloc_mw") + F.col("industry_alloc_mw")), "event_energy_mwh": F.sum("event_energy_mwh"),
            "flex_gap_mwh": F.sum(F.greatest(F.col("critical_mw") - F.col("flex_cover_mw"), F.lit(0.0))), "peak_mw": F.max("demand_mw"),
        }
        by = [F.col("month"), F.col("zone_id"), F.col("asset_type")]
        out = n.groupingSets([by[:2], by], *by).agg(F.grouping("asset_type").alias("whole"), *(v.alias(k) for k, v in sums.items()))
        service = self.outage_overlaps.groupBy(F.date_trunc("month", "ts_start").alias("month"), "zone_id").agg(F.count("outage_id").alias("n_outages"), F.sum("customers").alias("customers"), F.sum("ens_mwh").alias("ens_mwh"), F.sum("minutes").alias("minutes"))
        return out.join(service, ["month", "zone_id"], "left").fillna(0, ["n_outages", "customers", "ens_mwh", "minutes"])

    @cached_property
    def scenario_summary(self) -> DataFrame:
        sums = ("congestion", "ens", "curtailment", "flex_gap", "cost", "investment")
        return self.scenarios.groupBy("scenario").agg(F.avg("load").alias("load"), *(F.sum(c).alias(c) for c in sums), F.avg("scenario_priority").alias("scenario_priority"))
