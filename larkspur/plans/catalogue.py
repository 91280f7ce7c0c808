"""Registered queries over the driver's tables, and their DuckDB oracles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from larkspur.operators import censoring, closed_loop, evaluation, features, forecasting, lifecycle, panel, parity, quantile_boosting, release, simulation

from larkspur.streaming import conformal as conformal_stream
from larkspur.streaming import features as feature_stream

from .steps import TABLES, Node, Step, expressible, oracle, resolve

HORIZON = 14
CALIBRATION, VALIDATION, TEST = (167,), (181, 195), (209,)
ORIGINS = CALIBRATION + VALIDATION + TEST
CFG = simulation.InventoryConfig()

_t = {t: t for t in panel.CANONICAL.inputs}
_ft = {"forecast": "calibrated", "truth": "truth"}


def _node(step, keep: bool = False, **feeds: str) -> Node:
    return Node(step, feeds, keep)


def _select(sql: str):
    return Step(("x",), lambda d: sql)


GRAPH: dict[str, Node] = {
    "panel": Node(panel.CANONICAL, _t, True),
    "priced": _node(panel.PRICED, True, panel="panel"),
    "contract": _node(panel.CONTRACT, panel="priced"),
    "sampled": _node(panel.balanced(5000), panel="priced"),
    "cohort": _node(panel.cohort(12, 4), panel="priced"),
    "censored": _node(censoring.controlled_stockouts(), panel="priced"),
    "recovered": _node(censoring.RECOVERED, True, panel="censored"),
    "recovery": _node(censoring.DIAGNOSTICS, panel="recovered"),
    "draws": _node(censoring.posterior(), panel="recovered"),
    "featured": _node(features.time_features_step(), True, panel="recovered"),
    "training": _node(features.training_step(TEST[0], HORIZON), featured="featured"),
    "origin": _node(features.origin_step(TEST[0], HORIZON), featured="featured"),
    "regimes": _node(lifecycle.regime_step("recovered_demand_mean"), True, panel="recovered"),
    "states": _node(lifecycle.STATES, panel="regimes"),
    "life": Node(lifecycle.benchmark_step(), {}, True),
    "life_regimes": _node(lifecycle.regime_step("sales"), panel="life"),
    "life_states": _node(lifecycle.STATES, panel="life_regimes"),
    "life_scores": _node(lifecycle.SCORES, truth="life", estimate="life_states"),
    "seasonal": _node(forecasting.seasonal_step(ORIGINS, HORIZON), panel="recovered"),
    "smoothed": _node(forecasting.tsb_step(ORIGINS, HORIZON), panel="recovered"),
    "both": _node(forecasting.UNION, a="seasonal", b="smoothed"),
    "raw": _node(forecasting.REPAIR, True, forecast="both"),
    "truth": _node(_select("select series_id, date_idx, demand, category, store, promo, stockout, drat_state from {x}"), x="regimes"),
    "adjustment": _node(forecasting.adjustment_step(VALIDATION + TEST), forecast="raw", truth="truth"),
    "applied": _node(forecasting.applied_step(VALIDATION + TEST), True, forecast="raw", adjustment="adjustment"),
    "calibrated": _node(_select(f"select * from {{x}} where origin in {VALIDATION}"), True, x="applied"),
    "window": _node(_select(f"select series_id, date_idx, demand from {{x}} where date_idx > {VALIDATION[0]} and date_idx <= {VALIDATION[-1] + HORIZON}"), x="truth"),
    "coverage": _node(forecasting.KEY_COVERAGE, forecast="calibrated", truth="window"),
    "metrics": _node(evaluation.MODEL_METRICS, **_ft),
    "one_slice": _node(evaluation.slice_step(candidate="tsb"), **_ft),
    "router": _node(evaluation.router_step(), **_ft),
    "nodes": _node(evaluation.POINT_NODES, forecast="calibrated", metadata="truth"),
    "node_error": _node(evaluation.NODE_ERROR, nodes="nodes", forecast="calibrated"),
    "service": _node(simulation.quantile_step(CFG.service), forecast="calibrated"),
    "initial": _node(simulation.initial_step(CFG), True, forecast="calibrated"),
    "grid": _node(simulation.open_loop_step(CFG, simulation.SCALES), True, forecast="calibrated", truth="truth", initial="initial"),
    "simulated": _node(_select("select * from {x} where policy_scale = 1e0"), x="grid"),
    "kpis": _node(simulation.SUMMARY, simulation="grid"),
    "inventory": _node(_select("select * from {x} where policy_scale = 1e0"), x="kpis"),
    "tuning": _node(simulation.TUNING, summary="kpis"),
    "best": _node(simulation.BEST_POLICY, tuning="tuning"),
    "wins": _node(simulation.WIN_RATE, simulation="grid"),
    "tuned": _node(simulation.AT_BEST_SCALE, grid="grid", best="best"),
    "decision": _node(evaluation.decision_router_step(), forecast="calibrated", truth="truth", simulation="tuned"),
    "routed": _node(evaluation.ROUTED, forecast="calibrated", routing="decision"),
    "routing": _node(evaluation.ROUTING_SUMMARY, routing="decision"),
    "tested": _node(_select(f"select * from {{x}} where origin = {TEST[0]} and model = 'tsb'"), x="applied"),
    "paths": _node(simulation.paths_step(), True, forecast="tested"),
    "path_scores": _node(simulation.PATH_DIAGNOSTICS, scenarios="paths"),
    "path_nodes": _node(evaluation.PATH_NODES, forecast="paths", metadata="truth"),
    "loops": Node(closed_loop.paths_step(), {}),
    "replay": _node(closed_loop.replay_step(CFG), True, paths="loops"),
    "replay_summary": _node(closed_loop.REPLAY_SUMMARY, replay="replay"),
    "replay_slices": _node(closed_loop.REPLAY_SLICES, replay="replay"),
    "replay_comparison": _node(closed_loop.SLICE_COMPARISON, slices="replay_slices"),
    "sweep": _node(closed_loop.replay_step(CFG, safeties=closed_loop.SAFETIES), paths="loops"),
    "sweep_summary": _node(closed_loop.REPLAY_SUMMARY, replay="sweep"),
    "replay_worst": _node(release.REPLAY_SLICE_SUMMARY, slices="replay_comparison"),
    "path_error": _node(release.PATH_ERROR, nodes="path_nodes", scenarios="paths"),
    "policy_at_scale": _node(release.at_scale_step(1.0), tuning="all_tuning"),
    # Sources and router, tuned and chosen on the validation folds.
    "validated": _node(release.WITH_ROUTER, forecast="calibrated", routed="routed"),
    "router_grid": _node(simulation.open_loop_step(CFG, simulation.SCALES), True, forecast="routed", truth="truth", initial="initial"),
    "all_grid": _node(release.STACKED, a="grid", b="router_grid"),
    "all_kpis": _node(simulation.SUMMARY, simulation="all_grid"),
    "all_tuning": _node(simulation.TUNING, True, summary="all_kpis"),
    "chosen_scales": _node(simulation.BEST_POLICY, tuning="all_tuning"),
    "chosen_runs": _node(simulation.AT_BEST_SCALE, grid="all_grid", best="chosen_scales"),
    "chosen_kpis": _node(simulation.SUMMARY, simulation="chosen_runs"),
    "policies": _node(release.POLICIES, True, summary="chosen_kpis", simulation="chosen_runs"),
    "all_metrics": _node(evaluation.MODEL_METRICS, forecast="validated", truth="truth"),
    "all_slices": _node(evaluation.slice_step(), forecast="validated", truth="truth"),
    "all_worst": _node(evaluation.SLICE_SUMMARY, slices="all_slices"),
    "selection": _node(release.selection_step(), True, metrics="all_metrics", policies="policies", slices="all_worst"),
    # Held-out fold: the chosen model as the candidate, at the scales of the validation.
    "held_out": _node(release.held_out_step(TEST[0]), True, applied="applied", routing="decision", selection="selection"),
    "held_window": _node(_select(f"select series_id, date_idx, demand from {{x}} where date_idx > {TEST[0]} and date_idx <= {TEST[0] + HORIZON}"), x="truth"),
    "held_coverage": _node(forecasting.KEY_COVERAGE, forecast="held_out", truth="held_window"),
    "held_metrics": _node(evaluation.MODEL_METRICS, forecast="held_out", truth="truth"),
    "held_slices": _node(evaluation.slice_step(candidate=release.CANDIDATE), forecast="held_out", truth="truth"),
    "held_worst": _node(evaluation.SLICE_SUMMARY, slices="held_slices"),
    "held_nodes": _node(evaluation.POINT_NODES, forecast="held_out", metadata="truth"),
    "held_node_error": _node(evaluation.NODE_ERROR, nodes="held_nodes", forecast="held_out"),
    "held_initial": _node(simulation.initial_step(CFG), forecast="held_out"),
    "held_scales": _node(release.SCALES_OF, policies="policies", selection="selection"),
    "held_grid": _node(simulation.open_loop_step(CFG, simulation.SCALES), forecast="held_out", truth="truth", initial="held_initial"),
    "held_runs": _node(simulation.AT_BEST_SCALE, True, grid="held_grid", best="held_scales"),
    "held_kpis": _node(simulation.SUMMARY, simulation="held_runs"),
    "held_policies": _node(release.POLICIES, True, summary="held_kpis", simulation="held_runs"),
    "candidate": _node(_select(f"select * from {{x}} where model = '{release.CANDIDATE}'"), x="held_out"),
    "candidate_paths": _node(simulation.paths_step(), True, forecast="candidate"),
    "candidate_scores": _node(simulation.PATH_DIAGNOSTICS, scenarios="candidate_paths"),
    "candidate_nodes": _node(evaluation.PATH_NODES, forecast="candidate_paths", metadata="truth"),
    "candidate_error": _node(release.PATH_ERROR, nodes="candidate_nodes", scenarios="candidate_paths"),
    "gate_metrics": _node(
        release.GATE_METRICS, True, coverage="held_coverage", metrics="held_metrics", slices="held_worst", node_error="held_node_error", path_error="candidate_error", path_scores="candidate_scores",
        recovered="recovered", recovery="recovery", lifecycle="life_scores", summary="held_policies", policies="held_policies", replay="replay_summary", replay_slices="replay_worst",
    ),
    "gate": _node(release.gate_step(), values="gate_metrics"),
    "daily": _node(simulation.DAILY_MART, panel="recovered", regimes="regimes"),
    "kpi_mart": _node(simulation.KPI_MART, simulation="grid"),
    # Features stated twice, and the difference of both.
    "by_arrays": _node(parity.BY_ARRAYS, panel="recovered"),
    "parity": _node(parity.PARITY, left_side="featured", right_side="by_arrays"),
    # The same results from streams.
    "adjustment_streamed": _node(conformal_stream.streamed_step(ORIGINS, VALIDATION + TEST), True, forecast="raw", truth="truth"),
    "featured_streamed": _node(feature_stream.streamed_step(4, panel.DAYS), True, panel="recovered"),
    # Boosted quantile trees: no SQL states them.
    "direct_inputs": _node(quantile_boosting.DIRECT_INPUTS, True, featured="featured", regimes="regimes", recovered="recovered"),
    "direct": _node(quantile_boosting.direct_step(ORIGINS, HORIZON), True, inputs="direct_inputs"),
    "three": _node(forecasting.UNION, a="both", b="direct"),
}


def _again(graph: dict[str, Node], prefix: str, old: str, new: str) -> dict[str, Node]:
    """All that follows from node ``old``, once more from ``new``."""
    follows: set[str] = set()
    while more := {n for n, node in graph.items() if n not in follows and n != new and ({old} | follows) & {*node.feeds.values()}}:
        follows |= more
    feed = lambda v: new if v == old else prefix + v if v in follows else v
    return {prefix + n: Node(graph[n].step, {k: feed(v) for k, v in graph[n].feeds.items()}, graph[n].keep) for n in follows}


#: The whole chain behind the forecasts with boosted trees as a third source.
GRAPH |= _again(GRAPH, "boosted_", "both", "three")

_PANEL = "series_id, date_idx, ~sales, ~demand, stockout, ~price, promo, category, store, dow"
_F = "series_id, origin, date_idx, horizon, ~q10, ~q50, ~q90, model"
_REGIMES = "series_id, date_idx, " + ", ".join(f"~drat_{r}" for r in lifecycle.REGIMES) + ", ~drat_entropy, ~drat_velocity, drat_state, ~drat_progress"
_SIM = "model, series_id, date_idx, ~initial_inventory, ~opening_inventory, ~arrivals, ~demand, ~sales, ~lost_sales, ~ending_inventory, ~inventory_position, ~target_inventory_position, decision_eligible, is_review_period, ~order_qty, ~open_order_qty, stockout, ~cost, policy_scale"
_KPI = "model, policy_scale, ~total_cost, ~lost_sales, ~fill_rate, ~stockout_rate, ~average_inventory, ~order_volatility"
_SLICES = "model, dimension, slice_value, n, ~candidate_wape, ~baseline_wape, ~relative_wape_regression, ~candidate_signed_bias, ~baseline_signed_bias, ~candidate_coverage_80, ~baseline_coverage_80"
_REPLAY = "policy, recovery_safety, ~total_cost, ~lost_sales, ~stockout_rate, ~repeat_stockout_ratio, ~repeat_stockout_share, repeat_stockout_events, ~cumulative_bias, ~inventory_oscillation"

#: Query -> (node, columns); ~ marks a float, which is rounded to six digits.
OUTPUTS: dict[str, tuple[str, str]] = {
    "panel_canonical": ("panel", _PANEL),
    "panel_contract_counters": ("contract", "row_count, series_count, min_date, max_date, null_ids, bad_measures, bad_prices, bad_flags, bad_dow, demand_below_sales, duplicate_keys, short_series, broken_series, unaligned_bounds"),
    "price_imputed": ("priced", _PANEL),
    "balanced_sample": ("sampled", _PANEL),
    "cohort_selection": ("cohort", "series_id, category, store, ~score, volume_bin, place"),
    "censored_panel": ("censored", _PANEL + ", ~controlled_true_demand, controlled_stockout"),
    "recovered_panel": ("recovered", "series_id, date_idx, ~sales, ~recovered_demand_mean, ~recovery_uncertainty, ~recovered_q80, ~recovered_q95, ~recovery_confidence"),
    "recovery_diagnostics": ("recovery", "n_controlled, ~raw_mae, ~recovered_mae, ~raw_bias, ~recovered_bias, ~mae_improvement, ~absolute_bias_improvement, ~q80_upper_coverage, ~q95_upper_coverage, ~do_no_harm_max"),
    "posterior_draws": ("draws", "series_id, date_idx, draw, ~latent_demand_draw"),
    "time_features": ("featured", "series_id, date_idx, " + ", ".join(f"~{f}" for f in features.FEATURES)),
    "feature_parity": ("parity", "column_name, n, left_only, right_only, ~max_difference, agrees"),
    "time_features_streamed": ("featured_streamed", "series_id, date_idx, " + ", ".join(f"~{f}" for f in features.FEATURES)),
    "direct_training_frame": ("training", "series_id, date_idx, horizon, ~target, future_dow, ~future_price, future_promo, ~lag_7, ~roll_mean_14"),
    "origin_frame": ("origin", "series_id, date_idx, horizon, future_dow, ~future_price, future_promo, ~lag_1, ~roll_std_28, ~zero_ratio_14"),
    "drat_features": ("regimes", _REGIMES),
    "ladt_states": ("states", "series_id, date_idx, estimated_lifecycle_state, ~estimated_ladt"),
    "lifecycle_benchmark": ("life", "series_id, date_idx, ~sales, true_lifecycle_state, ~true_ladt"),
    "lifecycle_metrics": ("life_scores", "n, ~state_macro_f1, ~ladt_mae, ~ladt_spearman"),
    "seasonal_naive": ("seasonal", _F),
    "tsb": ("smoothed", _F),
    "repaired_forecasts": ("raw", _F),
    "conformal_adjustments": ("adjustment", "target_origin, model, horizon, ~adjustment, ~local_adjustment, ~pooled_adjustment, ~shrinkage_weight, n"),
    "conformal_adjustments_streamed": ("adjustment_streamed", "target_origin, model, horizon, ~adjustment, ~local_adjustment, ~pooled_adjustment, ~shrinkage_weight, n"),
    "conformal_applied": ("applied", _F),
    "forecast_key_coverage": ("coverage", "row_count, null_quantiles, negative_forecasts, quantile_crossing, bad_horizons, missing_keys, extra_keys, broken_horizons, null_ids, duplicate_keys"),
    "forecast_metrics": ("metrics", "model, n, ~wape, ~signed_bias, ~coverage_80, ~mean_interval_width, ~pinball_10, ~pinball_50, ~pinball_90"),
    "validation_slices": ("all_slices", _SLICES),
    "slice_report": ("one_slice", _SLICES),
    "slice_summary": ("all_worst", "model, n_slices, ~worst_relative_wape_regression, worst_slice, ~slice_win_rate"),
    "reconciled_points": ("nodes", "model, origin, date_idx, horizon, node_id, series_id, level, category, store, ~q10, ~q50, ~q90"),
    "hierarchy_error": ("node_error", "~hierarchy_max_error"),
    "service_quantile": ("service", "model, series_id, origin, date_idx, horizon, ~service_quantile"),
    "initial_inventory": ("initial", "series_id, ~initial_inventory"),
    "open_loop_sim": ("simulated", _SIM),
    "inventory_summary": ("inventory", _KPI),
    "policy_tuning": ("tuning", _KPI + ", meets_fill_guardrail"),
    "best_policy": ("best", "model, ~total_cost, ~lost_sales, ~fill_rate, policy_scale, ~baseline_fill_rate, ~fill_rate_degradation_vs_baseline, ~meets_service_guardrail"),
    "cost_win_rate": ("wins", "model, ~cost_win_rate_vs_baseline, n_series"),
    "series_router": ("router", "series_id, selected_model, ~selected_wape, ~baseline_wape, ~relative_improvement, n_validation_rows"),
    "decision_router": ("decision", "series_id, selected_model, ~selected_wape, ~baseline_wape, ~relative_improvement, n_validation_rows, ~selected_cost, ~baseline_cost, ~relative_cost_improvement, routing_reason"),
    "routed_forecast": ("routed", _F + ", routed_from_model"),
    "routing_summary": ("routing", "selected_model, n_series, ~own_validation_improvement, ~own_validation_cost_improvement, all_series, ~mean_validation_improvement, ~mean_validation_cost_improvement, ~fallback_rate"),
    "scenario_paths": ("paths", "model, series_id, scenario, date_idx, horizon, ~demand, ~q10_forecast, ~median_forecast, ~q90_forecast, ~interval_scale"),
    "scenario_diagnostics": ("path_scores", "n_scenarios, ~mean_lag1_correlation, negative_values, ~normalized_quantile_mae"),
    "reconciled_scenarios": ("path_nodes", "model, scenario, date_idx, horizon, node_id, series_id, level, category, store, ~demand"),
    "closed_loop_replay": ("replay", "policy, series_id, scenario_type, cycle, known_event, persistent_signal, stockout_streak, ~latent_demand, ~opening_inventory, ~observed_sales, ~recovered_demand, ~forecast, decision_eligible, is_review_period, ~target_inventory_position, ~arrivals, ~ending_inventory, ~order_qty, ~open_order_qty, stockout, ~lost_sales, ~cost"),
    "closed_loop_summary": ("replay_summary", _REPLAY),
    "closed_loop_slices": ("replay_slices", "policy, scenario_type, ~total_cost, ~lost_sales, ~fill_rate, ~stockout_rate, ~average_inventory"),
    "closed_loop_slice_compare": ("replay_comparison", "scenario_type, ~baseline_cost, ~candidate_cost, ~relative_cost_regression, ~baseline_lost_sales, ~candidate_lost_sales, ~fill_rate_degradation, ~stockout_rate_degradation"),
    "safety_sweep": ("sweep_summary", _REPLAY),
    "closed_loop_slice_summary": ("replay_worst", "n_slices, ~worst_relative_cost_regression, worst_cost_slice, ~worst_fill_rate_degradation, worst_fill_slice"),
    "scenario_hierarchy_error": ("path_error", "~scenario_hierarchy_error"),
    "policy_at_scale": ("policy_at_scale", _KPI),
    "selected_policy": ("policies", _KPI + ", ~cost_win_rate_vs_baseline"),
    "candidate_selection": ("selection", "selected_model, policy_scale, ~wape, ~worst_slice_regression, ~fill_rate, ~total_cost, ~cost_win_rate_vs_baseline"),
    "held_out_forecast": ("held_out", _F),
    "held_out_metrics": ("held_metrics", "model, n, ~wape, ~signed_bias, ~coverage_80, ~mean_interval_width, ~pinball_10, ~pinball_50, ~pinball_90"),
    "held_out_policy": ("held_policies", _KPI + ", ~cost_win_rate_vs_baseline"),
    "release_gate": ("gate", "check_name, ~value, critical, holds, gate_status"),
    "direct_quantile_forecast": ("direct", _F),
    "boosted_forecast_metrics": ("boosted_all_metrics", "model, n, ~wape, ~signed_bias, ~coverage_80, ~mean_interval_width, ~pinball_10, ~pinball_50, ~pinball_90"),
    "boosted_decision_router": ("boosted_decision", "series_id, selected_model, ~selected_wape, ~baseline_wape, ~relative_improvement, n_validation_rows, ~selected_cost, ~baseline_cost, ~relative_cost_improvement, routing_reason"),
    "boosted_candidate_selection": ("boosted_selection", "selected_model, policy_scale, ~wape, ~worst_slice_regression, ~fill_rate, ~total_cost, ~cost_win_rate_vs_baseline"),
    "boosted_held_out_metrics": ("boosted_held_metrics", "model, n, ~wape, ~signed_bias, ~coverage_80, ~mean_interval_width, ~pinball_10, ~pinball_50, ~pinball_90"),
    "boosted_release_gate": ("boosted_gate", "check_name, ~value, critical, holds, gate_status"),
    "mart_daily_demand": ("daily", "series_id, date_idx, category, store, ~sales, ~demand, stockout, promo, ~price, ~recovered_demand_mean, drat_state, ~drat_entropy, ~sql_lag_1, ~sql_roll_mean_7"),
    "mart_inventory_kpi": ("kpi_mart", "model, series_id, evaluated_days, ~total_demand, ~total_sales, ~total_lost_sales, ~total_cost, ~average_inventory, ~stockout_rate, ~fill_rate"),
}

#: Ids, flags and counts have one type in both engines.
_INTS = {"date_idx", "target_origin", "origin", "horizon", "stockout", "promo", "dow", "controlled_stockout", "draw", "future_dow", "future_promo", "scenario", "cycle", "known_event", "persistent_signal", "stockout_streak", "decision_eligible", "is_review_period", "min_date", "max_date"}
_LONGS = {"n", "row_count", "series_count", "n_series", "all_series", "n_slices", "n_scenarios", "negative_values", "evaluated_days", "n_validation_rows", "n_controlled", "duplicate_keys", "short_series", "broken_series", "unaligned_bounds", "missing_keys", "extra_keys", "broken_horizons", "critical", "holds", "left_only", "right_only"}


def _columns(text: str) -> list[str]:
    def one(c: str) -> str:
        if c.startswith("~"):  # + 0 turns a negative zero into zero
            return f"round(cast({c[1:]} as double), 6) + 0e0 as {c[1:]}"
        kind = "int" if c in _INTS else "bigint" if c in _LONGS else "double" if c in ("policy_scale", "recovery_safety") else ""
        return f"cast({c} as {kind}) as {c}" if kind else c

    return [one(c.strip()) for c in text.split(",")]


def _run(node: str, columns: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(GRAPH, node, spark, sf_dir).selectExpr(*_columns(columns))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel -> contract -> controlled censoring -> recovery -> daily mart."""
    panel.validate_panel(resolve(GRAPH, "priced", spark, sf_dir))
    return _run(*OUTPUTS["mart_daily_demand"], spark, sf_dir)


QUERIES = {name: partial(_run, node, columns) for name, (node, columns) in OUTPUTS.items()}


def oracles() -> dict[str, str]:
    return {name: oracle(GRAPH, node, f"select {', '.join(_columns(columns))} from n_{node}") for name, (node, columns) in OUTPUTS.items() if expressible(GRAPH, node)}


__all__ = ["GRAPH", "ORIGINS", "OUTPUTS", "QUERIES", "TABLES", "flagship", "oracles"]
