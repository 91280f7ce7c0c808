"""Model selection and the release gate: decisions over a few rows of metrics, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .evaluation import BASELINE


@dataclass(frozen=True)
class Check:
    """A bound on one metric. Where the metric is missing, the check fails."""

    path: str
    least: float | None = None
    most: float | None = None
    critical: bool = False

    def holds(self, metrics: dict) -> bool:
        value = metrics
        for part in self.path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value is None:
            return False
        return (self.least is None or value >= self.least) and (self.most is None or value <= self.most)


#: The checks of a release and their default bounds.
CHECKS: dict[str, Check] = {
    "truth_key_coverage": Check("truth_coverage_error", most=0, critical=True),
    "negative_forecasts": Check("negative_forecasts", most=0, critical=True),
    "quantile_crossing": Check("quantile_crossing", most=0, critical=True),
    "hierarchy_coherence": Check("hierarchy_max_error", most=1e-8, critical=True),
    "scenario_hierarchy_coherence": Check("scenario_hierarchy_error", most=1e-8, critical=True),
    "recovery_lower_bound": Check("recovery_lower_bound_violations", least=0, most=0, critical=True),
    "recovery_do_no_harm": Check("recovery_do_no_harm_max", most=1e-9, critical=True),
    "scenario_quantile_fidelity": Check("scenario_diagnostics.normalized_quantile_mae", most=0.25),
    "candidate_interval_coverage": Check("test_forecast_metrics.production_candidate.coverage_80", least=0.70, most=0.93),
    "recovery_mae_improvement": Check("recovery_diagnostics.mae_improvement", least=0.05),
    "recovery_bias_improvement": Check("recovery_diagnostics.absolute_bias_improvement", least=0.05),
    "recovery_q95_coverage": Check("recovery_diagnostics.q95_upper_coverage", least=0.75),
    "lifecycle_state_recovery": Check("lifecycle_metrics.state_macro_f1", least=0.50),
    "lifecycle_ladt_mae": Check("lifecycle_metrics.ladt_mae", most=0.16),
    "lifecycle_ladt_rank": Check("lifecycle_metrics.ladt_spearman", least=0.75),
    "candidate_wape": Check("candidate_wape_improvement", least=-0.02),
    "inventory_cost_win_rate": Check("cost_win_rate", least=0.50),
    "inventory_cost_regression": Check("candidate_cost_regression", most=0.05),
    "inventory_fill_rate": Check("candidate_fill_rate_degradation", most=0.01),
    "candidate_interval_sharpness": Check("candidate_interval_width_ratio", most=1.35),
    "forecast_worst_slice": Check("forecast_slice_summary.worst_relative_wape_regression", most=0.20),
    "forecast_slice_win_rate": Check("forecast_slice_summary.slice_win_rate", least=0.35),
    "closed_loop_stockout": Check("repeat_stockout_ratio", most=0.75),
    "closed_loop_stockout_improvement": Check("repeat_stockout_improvement", least=0.0),
    "closed_loop_cost": Check("closed_loop_cost_regression", most=0.10),
    "closed_loop_lost_sales": Check("closed_loop_lost_sales_improvement", least=-0.02),
    "closed_loop_worst_slice_cost": Check("closed_loop_slice_summary.worst_relative_cost_regression", most=0.25),
    "closed_loop_worst_slice_fill": Check("closed_loop_slice_summary.worst_fill_rate_degradation", most=0.01),
}


def evaluate_release(metrics: dict, overrides: dict[str, dict[str, float]] | None = None) -> dict:
    """FAIL if a critical check fails, PASS if all hold, else ITERATE. ``overrides`` replaces bounds
    by check name, as ``{"candidate_wape": {"least": 0.0}}``."""
    found, critical = {}, True
    for name, check in CHECKS.items():
        given = (overrides or {}).get(name, {})
        used = Check(**{f.name: given.get(f.name, getattr(check, f.name)) for f in fields(Check)})
        found[name] = used.holds(metrics)
        critical &= found[name] or not used.critical
    return {"gate_status": "FAIL" if not critical else "PASS" if all(found.values()) else "ITERATE", "checks": found, "metrics": metrics}


def choose_candidate(
    metrics: dict[str, dict],
    inventory: dict[str, dict] | None = None,
    slices: dict[str, dict] | None = None,
    baseline: str = BASELINE,
    wape_slack: float = 0.15,
    worst_slice: float = 0.20,
    width_ratio: float = 1.35,
    fill_slack: float = 0.0,
    cost_slack: float = 0.05,
) -> str:
    """Narrow the models by error, slices, sharpness and service, then take the cheapest; near
    ties in cost go by win rate, worst slice, error and cost. A stage that nobody passes leaves
    the baseline."""
    if baseline not in metrics:
        raise ValueError(f"the baseline {baseline} has no metrics")
    bound = (1 + wape_slack) * min(m["wape"] for m in metrics.values())
    pool = [m for m in metrics if m == baseline or metrics[m]["wape"] <= bound]
    slice_of = lambda m: (slices or {}).get(m, {}).get("worst_relative_wape_regression", 1.0)
    stages = []
    if slices:
        stages.append(lambda m: slice_of(m) <= worst_slice)
    width = metrics[baseline].get("mean_interval_width", 0.0)
    if width > 0:
        stages.append(lambda m: metrics[m].get("mean_interval_width", float("inf")) <= width * width_ratio)
    if inventory:
        if baseline not in inventory:
            raise ValueError(f"the baseline {baseline} has no inventory summary")
        stages.append(lambda m: m in inventory)
    for stage in stages:
        pool = [m for m in pool if stage(m)] or [baseline]
    if not inventory:
        return min(pool, key=lambda m: metrics[m]["wape"] + 0.2 * abs(metrics[m]["coverage_80"] - 0.8) + 0.1 * abs(metrics[m]["signed_bias"]))
    if all("fill_rate" in inventory[m] for m in pool):
        floor = inventory[baseline]["fill_rate"] - fill_slack
        pool = [m for m in pool if inventory[m]["fill_rate"] >= floor] or [baseline]
    cost = lambda m: inventory[m]["total_cost"]
    near = [m for m in pool if cost(m) <= min(map(cost, pool)) * (1 + cost_slack)]
    if len(near) > 1 and (slices or all("cost_win_rate_vs_baseline" in inventory[m] for m in near)):
        return min(near, key=lambda m: (-inventory[m].get("cost_win_rate_vs_baseline", 0.0), slice_of(m) if slices else 1.0, metrics[m]["wape"], cost(m)))
    return min(near, key=cost)
