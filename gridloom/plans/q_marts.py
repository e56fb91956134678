"""Queries of the integration layer, marts, decision views and features."""

from __future__ import annotations

from gridloom.plans.query import Query

NODE = "zone_id station_id feeder_id"

QUERIES = [
    Query("join_left_multi", "^ts zone_id ~zone_demand_mw ~top_feeder_mw ~generation_mw ~curtailment_mw ~ev_mw ~industry_mw ~growth_index ~ev_index", lambda m: m.zone_hour, "SELECT * FROM zone_hour"),
    Query("join_inner_chain", "zone_id station_id feeder_id grid_type ~capacity_mw ~capacity_share:6", lambda m: m.feeder_shares, "SELECT * FROM feeder_shares"),
    Query("join_fact_zonehour", f"^ts {NODE} ~demand_mw ~demand_share:6 ~load_ratio ~ev_alloc_mw ~industry_alloc_mw ~generation_alloc_mw ~curtailment_alloc_mw ~net_load_mw ~overload_mw", lambda m: m.node_load, "SELECT * FROM node_load"),
    Query("lateral_hour_expand", "event_id ^ts zone_id station_id feeder_id severity #severity_rank ~hour_energy_mwh", lambda m: m.event_hours, "SELECT * FROM event_hours"),
    Query("join_interval_overlap", "outage_id zone_id station_id severity #severity_rank #minutes #n_events #max_event_rank ~event_energy_mwh overlap_flag", lambda m: m.outage_overlaps, "SELECT * FROM outage_overlaps"),
    Query("flexibility_zone", "zone_id zone_name region ~peak_mw ~mean_mw ~feeders_mw ~stations_mw ~stations_firm_mw ~flex_mw ~flex_cost ~flex_availability ~storage_mw ~storage_mwh ~storage_availability ~capex_total:2 ~gain_total_mw ~mean_horizon ~mean_ease ~mean_resilience ~relief_mw ~intervention_cost:2 ~deploy_days ~complexity ~support_mw ~coverage_ratio", lambda m: m.flex_zone, "SELECT * FROM flex_zone"),
    Query("mart_node_state", f"^ts @day {NODE} grid_type ~demand_mw ~capacity_mw ~load_ratio ~net_load_mw ~net_load_ratio ~overload_mw ~ev_alloc_mw ~industry_alloc_mw ~generation_alloc_mw ~curtailment_alloc_mw ~flex_cover_mw ~storage_cover_mw ~critical_mw #n_events #max_rank ~event_energy_mwh ~temperature day_type hour_of_day peak_flag ~voltage ~growth_index high_load congested climate_stress voltage_stress stressed", lambda m: m.node_state, "SELECT * FROM node_state"),
    Query("mart_zone_day", "@day zone_id zone_name region zone_type ~demand_mwh ~net_load_mwh ~peak_mw ~max_load_ratio #high_load_hours #congested_hours #stressed_hours ~event_energy_mwh ~curtailment_mwh ~ev_mwh ~industry_mwh ~flex_cover_mw ~storage_cover_mw ~flex_gap_mwh ~flex_cost #n_outages #customers ~ens_mwh ~mean_minutes #overlapping_outages", lambda m: m.zone_day, "SELECT * FROM zone_day"),
    Query("mart_zone_month", "@month zone_id zone_name zone_type region ~demand_mwh ~net_load_mwh ~peak_mw ~max_load_ratio #high_load_hours #congested_hours #stressed_hours ~event_energy_mwh ~curtailment_mwh ~ev_mwh ~industry_mwh ~flex_cover_mw ~flex_gap_mwh ~flex_cost #n_outages #customers ~ens_mwh ~mean_minutes ~criticality ~climate_risk ~growth_tension", lambda m: m.zone_month, "SELECT * FROM zone_month"),
    Query("risk_zone", "zone_id zone_name zone_type region #congested_hours ~mean_rank #max_rank ~event_energy_mwh ~ens_mwh #customers ~peak_mw ~mean_max_load ~electrification ~flex_gap ~risk_score", lambda m: m.zone_risk, "SELECT * FROM zone_risk"),
    Query("assets_exposure", "asset_id asset_type zone_id station_id feeder_id age_years ~health ~failure_p ~criticality ~capex:2 #hours #stressed_hours #congested_hours ~mean_load ~max_load ~event_energy_mwh ~station_ens_mwh #station_customers #station_outages ~exposure_score ~adjusted_p:6", lambda m: m.asset_exposure, "SELECT * FROM asset_exposure"),
    Query("flexibility_gap", "zone_id zone_name region ~risk_score ~critical_mw ~flex_mw ~storage_mw ~support_mw ~flex_cost ~gap_mw ~gap_mwh ~economic_gap:2 ~flex_ratio #congested_hours ~electrification", lambda m: m.flex_gap, "SELECT * FROM flex_gap"),
    Query("investment_candidates", "investment_id zone_id zone_name zone_type region investment_type family strategy ~risk_score #congested_hours ~ens_mwh ~gap_mw ~flex_ratio ~capex:2 horizon_months ~ease ~risk_reduction ~capacity_gain ~resilience ~risk_relief ~relative_gain ~efficiency:8 ~priority_score", lambda m: m.candidates, "SELECT * FROM candidates"),
    Query("features_node", f"^ts {NODE} overloaded ~nearness ~volatility ~mean_24 ~max_168 #congested_168 #congested_720 #outages_720 ~vs_usual ~ev_pressure ~industry_pressure ~flex_coverage ~generation_share ~curtailment_ratio ~fragility ~climate_risk", lambda m: m.node_features, "SELECT * FROM node_features"),
    Query("features_zone_day", "@day zone_id #congested_hours ~mean_rank ~ens_mwh #customers ~load_p95 ~flex_gap_mwh ~exposure ~ev_mwh ~industry_mwh ~curtailment_mwh ~unserved_mwh ~risk_cost:3", lambda m: m.zone_day_features, "SELECT * FROM zone_day_features"),
    Query("features_zone_month", "@month zone_id ~demand_mwh #congested_hours ~trend_mwh ~seasonal ~recurrence ~risk ~resilience ~capex_intensity:2 ~flex_effective ~storage_effective ~growth_tension", lambda m: m.zone_month_features, "SELECT * FROM zone_month_features"),
    Query("features_candidates", "investment_id zone_id investment_type family driver ~technical ~economic:2 ~viability ~readiness ~risk_cost:2 ~mean_gap ~mean_exposure ~month_risk ~capex_intensity:2", lambda m: m.candidate_features, "SELECT * FROM candidate_features"),
]
