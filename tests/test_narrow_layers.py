"""The feeder-hours are written narrow, met by small stored layers where they lie, and the detectors read narrow rows."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators.quantiles import group_percentile
from gridloom.plans.decisions import Decisions
from gridloom.sources import tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def m(spark):
    m = Decisions(spark, FOLDER)
    yield m
    m.release()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_need_no_shuffle(m):
    assert "hashpartitioning" not in plan(m.node_state)
    assert m.node_state.count() == m.frame("demand").count()


def test_demand_meets_its_events_as_it_lies(spark, m):
    """The feeder-hours, added up by hour and feeder, aren't dealt out again for the join: one exchange for each side."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(Decisions(spark, FOLDER).feeder_hours).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_detectors_read_narrow_rows(m):
    m.keep("anomalies")
    assert not {"node_state", "node_features"} & set(m._kept)
    names = m.node_signals.columns
    assert len(names) < len(m.node_features.columns) / 3
    assert m.node_signals.exceptAll(m.node_features.select(names)).count() == 0 and m.node_signals.count() == m.node_features.count() > 0


def test_events_count_at_the_place_they_name(spark):
    """A feeder that stands at two substations within an hour, and events with null places, as a join by all four keys counts them."""
    hour = "timestamp '2024-01-01 05:00:00'"
    demand = spark.sql(f"SELECT {hour} AS ts, z AS zone_id, s AS station_id, f AS feeder_id, d AS demand_mw, 0.0D AS reactive_mw, 1 AS month_of_year FROM VALUES (1, 1, 7, 1.0D), (1, 2, 7, 2.0D), (1, 2, 7, 3.0D), (2, 2, 7, 4.0D), (NULL, 2, 7, 5.0D), (1, 1, 8, 6.0D) AS t(z, s, f, d)")
    events = spark.sql(f"SELECT e AS event_id, {hour} AS ts_start, {hour} AS ts_end, z AS zone_id, s AS station_id, f AS feeder_id, v AS severity, 2.0D AS energy_mwh FROM VALUES (1, 1, 1, 7, 'alta'), (2, 1, 1, 7, 'critica'), (3, 1, 2, 7, 'baja'), (4, NULL, 2, 7, 'alta'), (5, 9, 9, 7, 'alta'), (6, 1, 1, NULL, 'alta') AS t(e, z, s, f, v)")
    m = Decisions(spark, FOLDER, lambda role: {"demand": demand, "congestion": events}[role])
    got = {r.demand_mw: (r.n_events, r.max_rank, r.event_energy_mwh) for r in m.feeder_hours.collect()}
    none = (0, 0, 0.0)
    assert got == {1.0: (2, 4, 4.0), 2.0: (1, 1, 2.0), 3.0: (1, 1, 2.0), 4.0: none, 5.0: none, 6.0: none}


def test_rows_stay_where_they_are_for_few_percentiles(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("v"))
    assert "hashpartitioning" not in plan(group_percentile(df, "g", "v", 0.5, "p"))


def test_consistency_gates_read_what_was_written(m):
    from gridloom.plans import q_checks

    q_checks.gates(m)
    assert {"anomalies", "precursors"} <= set(m._kept)


def test_series_are_read_once(spark):
    m = Decisions(spark, FOLDER, lambda role: tables.role(spark, FOLDER, role))
    assert m.zone_series.count() > 0 and "day_series" in m._kept
    m.release()
