"""The domain's layers as DataFrames: integration, marts, decision views, features.

A layer is a lazy plan. One that several others read is written to the shared
folder the first time it is needed (``Marts.keep``) and read back from then on,
so no plan repeats another's scans; of the large layers these are the
feeder-hours as measured, with their events, and what the detectors read of
them; the others have a row for each zone and hour or fewer. The wide rows of
``node_state`` are made from them where they are read. ``Marts.release`` removes them when no result is read any more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import boundaries, count_if, known, ratio, severity_rank, weighted
from gridloom.operators.intervals import hourly, overlap_figures
from gridloom.operators.quantiles import group_percentile
from gridloom.operators.ranges import ALL
from gridloom.operators.ranges import month as by_month
from gridloom.operators.ranges import windowed
from gridloom.operators.scales import percent_of_max, share_of_max, with_totals
from gridloom.sources import tables
from gridloom.sources.shared import remove, stored

PHYSICAL = ("nuevo_alimentador", "refuerzo_selectivo_lineas", "repotenciacion_subestacion")
STORAGE = ("almacenamiento_red",)
OPERATION = ("automatizacion_avanzada", "digitalizacion_protecciones")


class Marts:
    """Layers over one folder of tables. ``frame(role)`` gives the domain frames."""

    def __init__(self, spark: SparkSession, sf_dir: str, frame: Callable[[str], DataFrame] | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self._frame = frame or (lambda role: tables.role(spark, sf_dir, role))
        self._frames: dict[str, DataFrame] = {}
        self._kept: dict[str, DataFrame] = {}
        self._paths: list[str] = []
        self._tables: dict[str, str] = {}

    def frame(self, role: str) -> DataFrame:
        if role not in self._frames:
            self._frames[role] = self._frame(role)
        return self._frames[role]

    def offered(self, role: str) -> DataFrame | None:
        """A frame that the source may or may not have."""
        try:
            return self.frame(role)
        except KeyError:
            return None

    def table(self, name: str) -> DataFrame:
        """A general table, for queries outside the domain."""
        return tables.load(self.spark, self.sf_dir, name)

    def keep(self, *layers: str) -> None:
        """Write layers to the shared folder, unless they are there, and use them from there."""
        for layer in layers:
            if self._kept.get(layer) is None or self._kept[layer] is not self.__dict__.get(layer):
                self._kept[layer] = self.__dict__[layer] = self.once(getattr(self, layer), layer)

    def once(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` as written to the shared folder, for a plan that reads it more than once."""
        out, path = stored(df, label)
        self._paths.append(path)
        return out

    def release(self) -> None:
        """Remove the kept layers; results that read them can't be read afterwards."""
        while self._paths:
            remove(self.spark, self._paths.pop())
        for layer in self._kept:
            self.__dict__.pop(layer, None)
        self._kept.clear()

    def save_table(self, layer: str, name: str, by: tuple[str, ...] = ("feeder_id",), order: tuple[str, ...] = ("ts",), buckets: int = 200, partition: str | None = None) -> DataFrame:
        """Write a layer as a catalogue table, bucketed by ``by`` and sorted within buckets, and use it from there.

        Later aggregates, joins and windows by ``by`` then need no exchange. Rows
        are dealt to their buckets first, so each bucket is one file a partition.
        Writing again replaces the table; ``release`` leaves it, as it is the user's.
        """
        if self._tables.get(layer) == name:
            self.__dict__.pop(layer, None)  # made anew, not read from the table that is replaced
        self._tables[layer] = name
        rows = getattr(self, layer).repartition(buckets, *by)
        out = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by, *order)
        (out.partitionBy(partition) if partition else out).saveAsTable(name)
        self._kept[layer] = self.__dict__[layer] = self.spark.table(name)
        return self.__dict__[layer]

    # integration

    @cached_property
    def zone_hour(self) -> DataFrame:
        """Demand by zone and hour, with generation, electric vehicles, industry and the base macro indices."""
        by = ["ts", "zone_id"]
        demand = self.frame("demand").groupBy(*by).agg(F.sum("demand_mw").alias("zone_demand_mw"), F.max("demand_mw").alias("top_feeder_mw"))
        out = demand
        for role, sums in (("generation", ("generation_mw", "curtailment_mw")), ("ev", ("ev_mw",)), ("industry", ("industry_mw",))):
            out = out.join(self.frame(role).groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums)), by, "left")
        macro = self.frame("macro").where("scenario = 'base'").select("day_no", "growth_index", "ev_index")
        out = out.withColumn("day_no", F.dayofyear("ts")).join(macro, "day_no", "left").drop("day_no")
        return out.withColumns({c: known(c, 1.0 if c.endswith("index") else 0.0) for c in ("generation_mw", "curtailment_mw", "ev_mw", "industry_mw", "growth_index", "ev_index")})

    @cached_property
    def feeder_shares(self) -> DataFrame:
        """Feeders with their zone and their share of its capacity."""
        chain = self.frame("feeders").join(self.frame("substations").select("station_id", "zone_id"), "station_id").join(self.frame("zones").select("zone_id"), "zone_id")
        return chain.withColumn("capacity_share", ratio("capacity_mw", F.sum("capacity_mw").over(Window.partitionBy("zone_id"))))

    def measured(self) -> DataFrame:
        """Demand without the columns that only the profile's rules read."""
        return self.frame("demand").drop("reactive_mw", "month_of_year")

    @cached_property
    def node_load(self) -> DataFrame:
        """Feeder-hours with the zone's components allotted by share of demand or of capacity."""
        return self.allotted(self.measured())

    def allotted(self, rows: DataFrame) -> DataFrame:
        """Feeder-hours with their feeder's figures and the zone's components."""
        # stored, these two are known to be small, and the feeder-hours that meet them needn't be shuffled
        self.keep("zone_hour", "feeder_shares")
        base = rows.join(self.feeder_shares.drop("base_load_mw"), ["feeder_id", "station_id", "zone_id"])
        # the zone's total is carried by the zone-hour row, so demand isn't shuffled for it
        out = base.join(self.zone_hour, ["ts", "zone_id"], "left").withColumn("demand_share", ratio("demand_mw", "zone_demand_mw"))
        out = out.withColumns({
            "load_ratio": ratio("demand_mw", "capacity_mw"),
            "ev_alloc_mw": F.col("ev_mw") * F.col("demand_share"),
            "industry_alloc_mw": F.col("industry_mw") * F.col("demand_share"),
            "generation_alloc_mw": F.col("generation_mw") * F.col("capacity_share"),
            "curtailment_alloc_mw": F.col("curtailment_mw") * F.col("capacity_share"),
        })
        return out.withColumns({"net_load_mw": F.col("demand_mw") - F.col("generation_alloc_mw"), "overload_mw": F.greatest(F.col("demand_mw") - F.col("capacity_mw"), F.lit(0.0))})

    @cached_property
    def events(self) -> DataFrame:
        """Congestion events with a severity rank and a duration in hours (boundaries crossed and one, at least one)."""
        return self.frame("congestion").withColumns({"severity_rank": severity_rank("severity"), "hours": F.greatest(boundaries("hour", "ts_start", "ts_end") + 1, F.lit(1))})

    @cached_property
    def event_hours(self) -> DataFrame:
        """A row for each hour of an event, with its part of the energy."""
        return hourly(self.events, "ts_start", "ts_end", "ts").withColumn("hour_energy_mwh", ratio("energy_mwh", "hours"))

    @cached_property
    def outages(self) -> DataFrame:
        minutes = F.greatest(boundaries("minute", "ts_start", "ts_end") + 1, F.lit(1))
        return self.frame("outages").withColumns({"severity_rank": severity_rank("severity"), "minutes": minutes, "hours": minutes / 60.0})

    @cached_property
    def outage_overlaps(self) -> DataFrame:
        """Outages with the congestion events of their substation that they overlap, event ends an hour later."""
        met = overlap_figures(self.outages, self.events, "station_id", "outage_id", "event_id", "severity_rank", "energy_mwh", "INTERVAL 1 HOUR")
        met = met.withColumnsRenamed({"n_met": "n_events", "top": "max_event_rank", "total": "event_energy_mwh"})
        out = self.outages.join(met, "outage_id", "left")
        out = out.withColumns({"n_events": known("n_events", 0), "max_event_rank": known("max_event_rank", 0), "event_energy_mwh": known("event_energy_mwh")})
        return out.withColumn("overlap_flag", F.col("n_events") > 0)

    @cached_property
    def flex_zone(self) -> DataFrame:
        """Zones with capacity, peak, flexibility, storage and investment figures."""
        self.keep("zone_hour")
        peak = self.zone_hour.groupBy("zone_id").agg(F.max("zone_demand_mw").alias("peak_mw"), F.avg("zone_demand_mw").alias("mean_mw"))
        # a substation counts once for each of its feeders
        capacity = self.frame("substations").select("station_id", "zone_id", F.col("capacity_mw").alias("s_mw"), "firm_mw").join(self.frame("feeders"), "station_id")
        capacity = capacity.groupBy("zone_id").agg(F.sum("capacity_mw").alias("feeders_mw"), F.sum("s_mw").alias("stations_mw"), F.sum("firm_mw").alias("stations_firm_mw"))
        flex = self.frame("flexibility").groupBy("zone_id").agg(F.sum("flex_mw").alias("flex_mw"), ratio(F.sum(F.col("cost_eur_mwh") * F.col("flex_mw")), F.sum("flex_mw")).alias("flex_cost"), F.avg("availability").alias("flex_availability"))
        store = self.frame("storage").groupBy("zone_id").agg(F.sum("power_mw").alias("storage_mw"), F.sum("energy_mwh").alias("storage_mwh"), F.avg("availability").alias("storage_availability"))
        invest = self.frame("investments").groupBy("zone_id").agg(F.sum("capex").alias("capex_total"), F.sum("capacity_gain").alias("gain_total_mw"), F.avg("horizon_months").alias("mean_horizon"), F.avg("ease").alias("mean_ease"), F.avg("resilience").alias("mean_resilience"))
        operate = self.frame("interventions").groupBy("zone_id").agg(F.sum("relief_mw").alias("relief_mw"), F.avg("cost").alias("intervention_cost"), F.avg("days").alias("deploy_days"), F.avg("complexity").alias("complexity"))
        out = self.frame("zones")
        for part in (peak, capacity, flex, store, operate, invest):
            out = out.join(part, "zone_id", "left")
        figures = [c for c in out.columns if c not in self.frame("zones").columns]
        out = out.withColumns({c: known(c) for c in figures})
        out = out.withColumn("support_mw", F.col("flex_mw") + F.col("storage_mw") * F.col("storage_availability"))
        return out.withColumn("coverage_ratio", ratio("support_mw", "peak_mw"))

    # marts

    @cached_property
    def feeder_hours(self) -> DataFrame:
        """Feeder-hours as measured, with the events of the hour: narrow rows, of which ``node_state`` is made without a shuffle."""
        keys = ["ts", "feeder_id"]
        hours = self.event_hours.repartition(*keys).groupBy(*keys, "zone_id", "station_id").agg(F.count("event_id").alias("n_events"), F.max("severity_rank").alias("max_rank"), F.sum("hour_energy_mwh").alias("event_energy_mwh"))
        # demand that was added up by hour and feeder lies as this join needs it; events count at the zone and substation they name
        hours = hours.groupBy(*keys).agg(F.collect_list(F.struct("zone_id", "station_id", "n_events", "max_rank", "event_energy_mwh")).alias("at_places"))
        out = self.measured().join(hours, keys, "left")
        out = out.withColumn("met", F.expr("filter(at_places, x -> x.zone_id = zone_id AND x.station_id = station_id)")).withColumn("met", F.when(F.size("met") > 0, F.col("met")[0]))
        out = out.withColumns({"n_events": known("met.n_events", 0), "max_rank": known("met.max_rank", 0), "event_energy_mwh": known("met.event_energy_mwh")})
        return out.drop("at_places", "met")

    @cached_property
    def node_state(self) -> DataFrame:
        """Feeder-hours with flexibility, events of the hour and five flags."""
        self.keep("feeder_hours", "flex_zone")
        flex = self.flex_zone.select("zone_id", "criticality", "growth_tension", "flex_mw", "storage_mw", "storage_availability", "support_mw", "flex_cost")
        out = self.allotted(self.feeder_hours).join(flex, "zone_id", "left")
        congested = (F.col("load_ratio") >= 1.0) | (F.col("overload_mw") > 0) | (F.col("n_events") > 0)
        volts = (F.col("voltage") < 0.94) | (F.col("voltage") > 1.06)
        yes = lambda c: F.coalesce(c, F.lit(False))
        return out.withColumns({
            "day": F.to_date("ts"),
            "net_load_ratio": ratio("net_load_mw", "capacity_mw"),
            "flex_cover_mw": known("support_mw") * F.col("demand_share"),
            "storage_cover_mw": known("storage_mw") * known("storage_availability") * F.col("demand_share"),
            "critical_mw": F.col("demand_mw") + F.col("ev_alloc_mw") + F.col("industry_alloc_mw"),
            "high_load": yes(F.col("load_ratio") >= 0.85),
            "congested": yes(congested),
            "climate_stress": yes((F.col("temperature") >= 33) | (F.col("climate_exposure") >= 0.7)),
            "voltage_stress": yes(volts),
            "stressed": yes(congested | (F.col("curtailment_alloc_mw") > 0) | volts),
        })

    @cached_property
    def zone_day(self) -> DataFrame:
        nodes = self.node_state.groupBy("day", "zone_id").agg(
            F.sum("demand_mw").alias("demand_mwh"), F.sum("net_load_mw").alias("net_load_mwh"), F.max("demand_mw").alias("peak_mw"), F.max("load_ratio").alias("max_load_ratio"),
            count_if(F.col("high_load")).alias("high_load_hours"), count_if(F.col("congested")).alias("congested_hours"), count_if(F.col("stressed")).alias("stressed_hours"),
            F.sum("event_energy_mwh").alias("event_energy_mwh"), F.sum("curtailment_alloc_mw").alias("curtailment_mwh"), F.sum("ev_alloc_mw").alias("ev_mwh"), F.sum("industry_alloc_mw").alias("industry_mwh"),
            F.avg("flex_cover_mw").alias("flex_cover_mw"), F.avg("storage_cover_mw").alias("storage_cover_mw"),
            F.sum(F.greatest(F.col("critical_mw") - F.col("flex_cover_mw"), F.lit(0.0))).alias("flex_gap_mwh"), F.avg("flex_cost").alias("flex_cost"),
        )
        service = self.outage_overlaps.groupBy(F.to_date("ts_start").alias("day"), "zone_id").agg(
            F.count("outage_id").alias("n_outages"), F.sum("customers").alias("customers"), F.sum("ens_mwh").alias("ens_mwh"), F.avg("minutes").alias("mean_minutes"), count_if(F.col("overlap_flag")).alias("overlapping_outages"))
        out = nodes.join(self.frame("zones"), "zone_id").join(service, ["day", "zone_id"], "left")
        return out.withColumns({c: known(c, 0 if c in ("n_outages", "customers", "overlapping_outages") else 0.0) for c in ("n_outages", "customers", "ens_mwh", "mean_minutes", "overlapping_outages")})

    @cached_property
    def zone_month(self) -> DataFrame:
        sums = ("demand_mwh", "net_load_mwh", "high_load_hours", "congested_hours", "stressed_hours", "event_energy_mwh", "curtailment_mwh", "ev_mwh", "industry_mwh", "flex_gap_mwh", "n_outages", "customers", "ens_mwh", "overlapping_outages")
        means = ("max_load_ratio", "flex_cover_mw", "storage_cover_mw", "flex_cost", "mean_minutes", "criticality", "climate_risk", "growth_tension")
        carried = ("zone_name", "zone_type", "region")
        return self.zone_day.groupBy(F.date_trunc("month", "day").alias("month"), "zone_id").agg(*(F.max(c).alias(c) for c in carried), F.max("peak_mw").alias("peak_mw"), *(F.sum(c).alias(c) for c in sums), *(F.avg(c).alias(c) for c in means))

    # decision views

    @cached_property
    def zone_risk(self) -> DataFrame:
        days = self.zone_day.groupBy("zone_id").agg(
            *(F.max(c).alias(c) for c in ("zone_name", "zone_type", "region", "criticality", "growth_tension", "peak_mw")), *(F.sum(c).alias(c) for c in ("congested_hours", "event_energy_mwh", "ens_mwh", "customers")),
            F.avg("max_load_ratio").alias("mean_max_load"), known(F.avg(ratio(F.col("ev_mwh") + F.col("industry_mwh"), "demand_mwh"))).alias("electrification"), known(F.avg(ratio("flex_gap_mwh", "demand_mwh"))).alias("flex_gap"))
        ranks = self.events.groupBy("zone_id").agg(F.avg("severity_rank").alias("mean_rank"), F.max("severity_rank").alias("max_rank"))
        base = days.join(ranks, "zone_id", "left").withColumns({"mean_rank": known("mean_rank"), "max_rank": known("max_rank", 0)})
        # fixed values: the score's weights
        parts = {"congested_hours": 0.24, "mean_rank": 0.16, "ens_mwh": 0.18, "customers": 0.14, "mean_max_load": 0.10}
        score = weighted([*((w, percent_of_max(c)) for c, w in parts.items()), (0.09, F.lit(100.0) * F.col("criticality")), (0.09, F.lit(100.0) * F.col("growth_tension"))])
        return share_of_max(self.once(base, "zone_risk_base"), list(parts)).withColumn("risk_score", score).drop(*(f"max_{c}" for c in parts))

    @cached_property
    def asset_exposure(self) -> DataFrame:
        nodes = self.node_state.groupBy("station_id", "feeder_id").agg(F.count(F.lit(1)).alias("hours"), count_if(F.col("stressed")).alias("stressed_hours"), count_if(F.col("congested")).alias("congested_hours"), F.avg("load_ratio").alias("mean_load"), F.max("load_ratio").alias("max_load"), F.sum("event_energy_mwh").alias("event_energy_mwh"))
        service = self.outages.groupBy("station_id").agg(F.sum("ens_mwh").alias("station_ens_mwh"), F.sum("customers").alias("station_customers"), F.count("outage_id").alias("station_outages"))
        n = nodes.select(F.col("station_id").alias("n_station"), F.col("feeder_id").alias("n_feeder"), *(c for c in nodes.columns if not c.endswith("_id")))
        assets = self.frame("assets").join(self.frame("substations").select("station_id", "zone_id"), "station_id", "left")
        out = assets.join(n, (F.col("station_id") == F.col("n_station")) & F.col("feeder_id").eqNullSafe(F.col("n_feeder")), "left").drop("n_station", "n_feeder").join(service, "station_id", "left")
        out = out.withColumns({c: known(c, 0 if c in ("hours", "stressed_hours", "congested_hours", "station_customers", "station_outages") else 0.0) for c in ("hours", "stressed_hours", "congested_hours", "mean_load", "max_load", "event_energy_mwh", "station_ens_mwh", "station_customers", "station_outages")})
        stress = ratio("stressed_hours", "hours")
        out = share_of_max(self.once(out, "asset_base"), ["age_years"])
        # fixed values: the score's weights
        score = weighted([(0.26, percent_of_max("age_years")), (0.18, F.lit(100.0) * (F.lit(1.0) - F.col("health"))), (0.16, F.lit(100.0) * F.col("criticality")), (0.20, F.lit(100.0) * stress), (0.20, F.lit(100.0) * F.col("failure_p"))])
        return out.withColumns({"exposure_score": score, "adjusted_p": F.least(F.lit(1.0), F.col("failure_p") * (F.lit(1.0) + F.lit(0.35) * stress))}).drop("max_age_years")

    @cached_property
    def flex_gap(self) -> DataFrame:
        self.keep("zone_day", "zone_risk")
        months = self.zone_month.groupBy("zone_id").agg(F.max("peak_mw").alias("critical_mw"), F.sum("stressed_hours").alias("stressed_total"), F.avg("flex_gap_mwh").alias("gap_mwh"))
        risk = self.zone_risk.select("zone_id", "risk_score", "congested_hours", "electrification")
        out = self.flex_zone.drop("peak_mw").join(risk, "zone_id", "left").join(months, "zone_id", "left")
        out = out.withColumns({c: known(c, 0 if c == "congested_hours" else 0.0) for c in ("risk_score", "congested_hours", "electrification", "critical_mw", "gap_mwh")}).withColumn("stressed_total", known("stressed_total", 0))
        out = with_totals(self.once(out, "flex_gap_base"), n_zones=F.count(F.lit(1)))
        gap = F.greatest(F.col("critical_mw") - F.col("support_mw"), F.lit(0.0))
        return out.withColumns({"gap_mw": gap, "economic_gap": gap * F.col("flex_cost") * ratio("stressed_total", "n_zones"), "flex_ratio": ratio("support_mw", "critical_mw")})

    @cached_property
    def candidates(self) -> DataFrame:
        """Investments with family, strategy and first priority."""
        kind = F.col("investment_type")
        family = F.when(kind.isin(*PHYSICAL), "refuerzo_fisico").when(kind.isin(*STORAGE), "storage_distribuido").when(kind.isin(*OPERATION), "operacion_avanzada").otherwise("flexibilidad_operativa")
        self.keep("zone_risk", "flex_gap")
        context = self.zone_risk.select("zone_id", "risk_score", "congested_hours", "ens_mwh", "peak_mw").join(self.flex_gap.select("zone_id", "gap_mw", "flex_ratio"), "zone_id", "left")
        out = self.frame("investments").withColumn("family", family).join(context, "zone_id", "left")
        out = out.withColumns({c: known(c, 0 if c == "congested_hours" else 0.0) for c in ("risk_score", "congested_hours", "ens_mwh", "peak_mw", "gap_mw", "flex_ratio")})
        relief = F.col("risk_reduction") * F.col("risk_score")
        out = out.withColumns({"risk_relief": relief, "relative_gain": ratio(F.col("capacity_gain") * F.col("peak_mw"), "gap_mw"), "efficiency": ratio(relief + F.lit(15.0) * F.col("resilience"), "capex"), "strategy": F.when(F.col("family") == "refuerzo_fisico", "refuerzo").when(F.col("family").isin("storage_distribuido", "flexibilidad_operativa"), "flexibilidad").otherwise("operacion")})
        out = share_of_max(self.once(out, "candidate_base"), ["resilience", "capacity_gain", "efficiency", "horizon_months"])
        # fixed values: the score's weights
        score = weighted([(0.28, F.lit(100.0) * F.col("risk_reduction")), (0.22, percent_of_max("resilience")), (0.18, percent_of_max("capacity_gain")), (0.12, percent_of_max("efficiency")), (0.10, F.lit(100.0) * F.col("ease")), (0.10, F.lit(100.0) * (F.lit(1.0) - ratio("horizon_months", "max_horizon_months")))])
        out = out.withColumn("priority_score", score)
        return out.join(self.frame("zones").select("zone_id", "zone_name", "zone_type", "region"), "zone_id", "left")

    # features

    @cached_property
    def node_features(self) -> DataFrame:
        """Rolling features of each feeder's hours; all frames of a feeder share one shuffle."""
        self.keep("asset_exposure")
        # a substation's feeders tie on the hour; the feeder makes the order total
        stations = self.node_state.select("station_id", "ts", "feeder_id").distinct()
        failed = hourly(self.outages.select("station_id", "ts_start", "ts_end"), "ts_start", "ts_end", "ts").groupBy("station_id", "ts").agg(F.count(F.lit(1)).alias("outages_now"))
        frail = self.asset_exposure.groupBy("station_id", "feeder_id").agg((F.avg("exposure_score") / 100.0).alias("fragility"))
        zones = self.frame("zones").select("zone_id", "climate_risk")
        # narrow rows, in blocks that carry the 719 rows before: no substation's history is one task
        failed = windowed(stations.join(failed, ["station_id", "ts"], "left").withColumn("outages_now", known("outages_now", 0)), ["station_id"], by_month("ts"), ["ts", "feeder_id"], {"outages_720": lambda w: F.sum("outages_now").over(w.rowsBetween(-719, 0))}, back=719)
        n = self.node_state.join(failed, ["station_id", "ts", "feeder_id"], "left").join(frail, ["station_id", "feeder_id"], "left").join(zones, "zone_id", "left")
        n = n.withColumns({"outages_now": known("outages_now", 0), "fragility": known("fragility"), "congested_now": F.col("congested").cast("int")})
        own = Window.partitionBy("feeder_id").orderBy("ts")
        day, week, month = own.rowsBetween(-23, 0), own.rowsBetween(-167, 0), own.rowsBetween(-719, 0)
        n = n.withColumns({
            "overloaded": F.when(F.col("load_ratio") >= 1.0, 1).otherwise(0),
            "nearness": F.greatest(F.least(F.lit(1.0) - F.abs(F.lit(1.0) - F.col("load_ratio")), F.lit(1.0)), F.lit(0.0)),
            "volatility": F.stddev_samp("demand_mw").over(day),
            "max_168": F.max("load_ratio").over(week),
            "congested_168": F.sum("congested_now").over(week),
            "congested_720": F.sum("congested_now").over(month),
        })
        return self.compared(n).withColumns({
            "ev_pressure": ratio("ev_alloc_mw", "demand_mw"),
            "industry_pressure": ratio("industry_alloc_mw", "demand_mw"),
            "flex_coverage": ratio("flex_cover_mw", "demand_mw"),
            "generation_share": ratio("generation_alloc_mw", "demand_mw"),
        })

    def compared(self, nodes: DataFrame) -> DataFrame:
        """Feeder-hours beside the feeder's last day, its usual demand and its generation; one shuffle by feeder."""
        keys = ["feeder_id", "station_id", "zone_id", "hour_of_day", "day_type"]
        n = nodes.withColumn("mean_24", F.avg("demand_mw").over(Window.partitionBy("feeder_id").orderBy("ts").rowsBetween(-23, 0)))
        # added up from the last hour back, so that a deviation that lies on a limit doesn't depend on how rows were shuffled
        same = Window.partitionBy(*keys).orderBy(F.desc("ts")).rowsBetween(*ALL)
        n = n.withColumn("usual_mw", F.when(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)), F.avg("demand_mw").over(same)))
        return n.withColumns({
            "vs_usual": ratio(F.col("demand_mw") - F.coalesce("usual_mw", "demand_mw"), F.coalesce("usual_mw", "demand_mw")),
            "curtailment_ratio": ratio("curtailment_alloc_mw", "generation_alloc_mw"),
        })

    @cached_property
    def node_signals(self) -> DataFrame:
        """What the detectors read of ``node_features``, in narrow rows of their own."""
        keys = ["ts", "day", "zone_id", "station_id", "feeder_id"]
        read = ["demand_mw", "load_ratio", "congested", "peak_flag"]
        n = self.node_state.select(*keys, *read, "hour_of_day", "day_type", "generation_alloc_mw", "curtailment_alloc_mw")
        return self.compared(n).select(*keys, *read, "mean_24", "vs_usual", "curtailment_ratio")

    @cached_property
    def zone_day_features(self) -> DataFrame:
        ranks = self.events.groupBy("zone_id", F.to_date("ts_start").alias("day")).agg(F.avg("severity_rank").alias("mean_rank"))
        assets = self.asset_exposure.groupBy("zone_id").agg(F.avg("exposure_score").alias("exposure"))
        self.keep("zone_day")
        out = group_percentile(self.zone_day, "zone_id", "max_load_ratio", 0.95, "load_p95", self.once).join(ranks, ["zone_id", "day"], "left").join(assets, "zone_id", "left")
        return out.withColumns({
            "mean_rank": known("mean_rank"), "exposure": known("exposure"),
            "unserved_mwh": F.col("ens_mwh") + F.lit(0.15) * F.col("curtailment_mwh"), "risk_cost": weighted({"ens_mwh": 2500.0, "curtailment_mwh": 90.0, "congested_hours": 45.0})})

    @cached_property
    def zone_month_features(self) -> DataFrame:
        self.keep("zone_month")
        w = Window.partitionBy("zone_id")
        out = share_of_max(self.zone_month, ["congested_hours", "ens_mwh", "flex_gap_mwh"])
        # fixed values: the weights of risk, resilience and capital
        return out.withColumns({
            "trend_mwh": F.col("demand_mwh") - F.lag("demand_mwh").over(w.orderBy("month")),
            "seasonal": ratio("demand_mwh", F.avg("demand_mwh").over(w)),
            "recurrence": F.col("congested_hours") / 720.0,
            "risk": weighted([(0.28, percent_of_max("congested_hours")), (0.24, percent_of_max("ens_mwh")), (0.20, percent_of_max("flex_gap_mwh")), (0.14, F.lit(100.0) * F.col("criticality")), (0.14, F.lit(100.0) * F.col("growth_tension"))]),
            "resilience": F.lit(100.0) - weighted([(0.40, percent_of_max("ens_mwh")), (0.30, percent_of_max("congested_hours")), (0.30, F.lit(100.0) * F.col("climate_risk"))]),
            "capex_intensity": weighted({"peak_mw": 320.0, "flex_gap_mwh": 28.0}),
            "flex_effective": ratio("flex_cover_mw", "peak_mw"),
            "storage_effective": ratio("storage_cover_mw", "peak_mw"),
        })

    @cached_property
    def candidate_features(self) -> DataFrame:
        self.keep("zone_day", "candidates")
        new = F.col("ev_mwh") + F.col("industry_mwh") + F.lit(1e-9)
        days = self.zone_day_features.groupBy("zone_id").agg(F.avg("risk_cost").alias("risk_cost"), F.avg("flex_gap_mwh").alias("mean_gap"), F.avg("exposure").alias("mean_exposure"), F.avg(ratio("ev_mwh", new)).alias("ev_weight"))
        months = self.zone_month_features.groupBy("zone_id").agg(F.avg("risk").alias("month_risk"), F.avg("capex_intensity").alias("capex_intensity"), F.avg("flex_effective").alias("flex_effective"), F.avg("storage_effective").alias("storage_effective"))
        out = self.candidates.join(days, "zone_id", "left").join(months, "zone_id", "left")
        out = out.withColumns({c: known(c) for c in ("risk_cost", "mean_gap", "mean_exposure", "ev_weight", "month_risk", "capex_intensity", "flex_effective", "storage_effective")})
        driver = F.when(F.col("risk_score") >= 75, "congestion_estructural").when(F.col("mean_exposure") >= 65, "degradacion_activos").when(F.col("mean_gap") >= 25, "brecha_flexibilidad").when(F.col("ev_weight") >= 0.6, "presion_ev").otherwise("presion_electrificacion_industrial")
        # fixed values: the weights of the four indices
        return out.withColumns({
            "driver": driver,
            "technical": weighted({"risk_score": 0.35, "month_risk": 0.25, "mean_exposure": 0.20, "mean_gap": 0.20}),
            "economic": weighted({"risk_cost": 0.45, "capex_intensity": 0.35, "capex": 0.20}),
            "viability": weighted([(0.45, F.lit(100.0) * F.col("flex_effective")), (0.35, F.lit(100.0) * F.col("storage_effective")), (0.20, F.lit(100.0) * F.col("ease"))]),
            "readiness": weighted([(0.40, F.lit(100.0) * F.col("ease")), (0.30, F.lit(100.0) * (F.lit(1.0) - ratio("horizon_months", "max_horizon_months"))), (0.30, percent_of_max("resilience"))]),
        })
