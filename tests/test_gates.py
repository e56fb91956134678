"""The release gates count every check, those on the marts as well."""

from gridloom.plans import registry
from gridloom.plans.decisions import Decisions
from gridloom.plans.q_kpi import CHECKS

FOLDER = "/root/testdata/sf0.001"


def test_duplicate_node_hours_fail_the_release(spark):
    plan = registry.catalogue()["dq_release_gates"].plan
    m = Decisions(spark, FOLDER)
    status = {r.severity: r for r in plan(m).collect()}
    assert sum(r.checks for r in status.values()) == len(CHECKS) == 14
    for layer in ("node_state", "flex_gap", "outage_overlaps", "zone_risk"):
        getattr(m, layer)
    m.__dict__["node_state"] = m.node_state.unionByName(m.node_state.limit(1))
    twice = {r.severity: r for r in plan(m).collect()}
    assert twice["alta"].failed == status["alta"].failed + 1 and twice["alta"].status == "FAIL"
