"""The domain's queries against their SQL, run by DuckDB on the same small tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from gridloom.plans import q_board, q_checks, q_groups, q_kpi, q_layers, q_rows, registry
from gridloom.plans.decisions import Decisions

FOLDER = "/root/testdata/sf0.001"
ALSO = ["flexibility_zone", "assets_exposure", "mart_node_state", "mart_zone_month", "features_zone_month", "features_node", "features_candidates", "flexibility_gap", "investment_candidates", "join_interval_overlap", "anom_demand_z", "anom_load_p99", "anom_ids", "anom_zone_intensity", "fc_naive_seasonal_ma", "fc_benchmark", "fc_winner", "fc_predictability", "score_seven", "score_options_best", "score_priority_rules", "score_sensitivity", "scenario_impacts", "scenario_summary", "what_if"]
NAMES = [q.name for module in (q_kpi, q_rows, q_groups, q_board, q_checks, q_layers) for q in module.QUERIES] + ["mart_zone_day", "risk_zone", *ALSO]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    out = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def layers(spark):
    shared = Decisions(spark, FOLDER)
    yield shared
    shared.release()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, layers, name):
    got = registry.catalogue()[name].run(spark, FOLDER, layers)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(tuple(r) for r in got.select(*names).collect()) == plain(want.fetchall())
