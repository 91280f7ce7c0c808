"""From validated models to a release: policies at their tuned scales, the choice of a candidate,
its held-out forecasts and the gate, each as a query over computed metrics."""

from __future__ import annotations

from larkspur.functions.dialect import Dialect
from larkspur.plans.steps import Step

from .closed_loop import AWARE, NAIVE
from .evaluation import BASELINE
from .gates import CHECKS

CANDIDATE = "production_candidate"
_COLUMNS = "series_id, origin, date_idx, horizon, q10, q50, q90, model"

WITH_ROUTER = Step(("forecast", "routed"), lambda d: f"select {_COLUMNS} from {{forecast}} union all select {_COLUMNS} from {{routed}}")
STACKED = Step(("a", "b"), lambda d: "select * from {a} union all select * from {b}")


def at_scale_step(scale: float = 1.0) -> Step:
    """The rows of a tuning table at one scale."""
    return Step(("tuning",), lambda d: f"select * from {{tuning}} where abs(policy_scale - {scale}e0) <= 1e-8")


#: KPIs of simulations at the tuned scales, and the share of series that cost no more than the baseline's.
POLICIES = Step(("summary", "simulation"), lambda d: f"""
    with c as (select model, series_id, sum(cost) as cost from {{simulation}} group by model, series_id),
    w as (select c.model, avg(case when {d.at_most('c.cost', 'b.cost')} then 1e0 else 0e0 end) as cost_win_rate_vs_baseline from c join c b on b.series_id = c.series_id and b.model = '{BASELINE}' group by c.model)
    select s.*, w.cost_win_rate_vs_baseline from {{summary}} s join w on w.model = s.model""")


def selection_step(wape_slack: float = 0.15, worst_slice: float = 0.20, width_ratio: float = 1.35, fill_slack: float = 0.0, cost_slack: float = 0.05) -> Step:
    """One row, the chosen model. Each stage narrows the pool of the one before; a stage that nobody
    passes leaves the baseline, whose own slices are no regression."""

    def sql(d: Dialect) -> str:
        base = "max(case when base = 1 then {} end) over ()"
        stages = [
            f"(base = 1 or wape <= {1 + wape_slack}e0 * min(wape) over ())",
            f"worst <= {worst_slice}e0",
            f"({base.format('width')} <= 0 or width <= {width_ratio}e0 * {base.format('width')})",
            f"fill_rate >= {base.format('fill_rate')} - {fill_slack}e0",
            f"total_cost <= {1 + cost_slack}e0 * min(case when p3 = 1 then total_cost end) over ()",
        ]
        text = [f"""
        u as (select m.model, m.wape, m.mean_interval_width as width, case when m.model = '{BASELINE}' then 0e0 else coalesce(s.worst_relative_wape_regression, 1e0) end as worst, p.fill_rate, p.total_cost, p.policy_scale,
                     p.cost_win_rate_vs_baseline as wins, case when m.model = '{BASELINE}' then 1 else 0 end as base
              from {{metrics}} m join {{policies}} p on p.model = m.model left join {{slices}} s on s.model = m.model)"""]
        last = "u"
        for k, holds in enumerate(stages):
            before = f"p{k - 1} = 1 and " if k else ""
            text += [f"t{k} as (select {last}.*, case when {before}{holds} then 1 else 0 end as o{k} from {last})", f"u{k} as (select t{k}.*, case when max(o{k}) over () = 1 then o{k} else base end as p{k} from t{k})"]
            last = f"u{k}"
        pool = f"p{len(stages) - 1}"
        return f"""
        with {", ".join(text)},
        r as (select {last}.*, row_number() over (order by {pool} desc, round(wins, 9) desc, round(worst, 9), round(wape, 9), round(total_cost, 9), model) as place from {last})
        select model as selected_model, policy_scale, wape, worst as worst_slice_regression, fill_rate, total_cost, wins as cost_win_rate_vs_baseline from r where place = 1"""

    return Step(("metrics", "policies", "slices"), sql)


def held_out_step(origin: int) -> Step:
    """Forecasts of ``origin`` by each model, by the router and, as the candidate, by the chosen one."""
    own = _COLUMNS.replace(", model", "")
    return Step(("applied", "routing", "selection"), lambda d: f"""
    with t as (select {_COLUMNS} from {{applied}} where origin = {origin}),
    r as (select t.*, s.selected_model from t join {{routing}} s on s.series_id = t.series_id and s.selected_model = t.model),
    a as (select {_COLUMNS} from t union all select {own}, 'reliability_router' as model from r),
    c as (select a.* from a join {{selection}} s on s.selected_model = a.model)
    select {_COLUMNS} from a union all select {own}, '{CANDIDATE}' as model from c""")


SCALES_OF = Step(("policies", "selection"), lambda d: f"select model, policy_scale from {{policies}} union all select '{CANDIDATE}' as model, policy_scale from {{selection}}")

PATH_ERROR = Step(("nodes", "scenarios"), lambda d: """
    with t as (select model, scenario, date_idx, horizon, demand from {nodes} where level = 'total' union all select model, scenario, date_idx, horizon, -demand from {scenarios}),
    k as (select model, scenario, date_idx, horizon, abs(sum(demand)) as error from t group by model, scenario, date_idx, horizon)
    select coalesce(max(error), 0e0) as scenario_hierarchy_error from k""")

REPLAY_SLICE_SUMMARY = Step(("slices",), lambda d: f"""
    select count(*) as n_slices, coalesce(max(relative_cost_regression), 0e0) as worst_relative_cost_regression, {d.best('scenario_type', '-round(relative_cost_regression, 9)', 'scenario_type')} as worst_cost_slice,
           coalesce(max(fill_rate_degradation), 0e0) as worst_fill_rate_degradation, {d.best('scenario_type', '-round(fill_rate_degradation, 9)', 'scenario_type')} as worst_fill_slice from {{slices}}""")

_GATE_INPUTS = ("coverage", "metrics", "slices", "node_error", "path_error", "path_scores", "recovered", "recovery", "lifecycle", "summary", "policies", "replay", "replay_slices")


def _pair(name: str, key: str, a: str, b: str, columns: str) -> str:
    """One row of ``columns`` of the rows ``a`` and ``b`` of a relation, with prefixes a_ and b_."""
    cells = [f"max(case when {key} = '{v}' then {c} end) as {p}_{c}" for p, v in (("a", a), ("b", b)) for c in columns.split()]
    return f"(select {', '.join(cells)} from {{{name}}})"


#: One row with the value of each check under the check's name.
GATE_METRICS = Step(_GATE_INPUTS, lambda d: f"""
    select c.missing_keys + c.extra_keys as truth_key_coverage, c.negative_forecasts as negative_forecasts, c.quantile_crossing as quantile_crossing, n.hierarchy_max_error as hierarchy_coherence,
           e.scenario_hierarchy_error as scenario_hierarchy_coherence, w.below as recovery_lower_bound, r.do_no_harm_max as recovery_do_no_harm, x.normalized_quantile_mae as scenario_quantile_fidelity,
           m.a_coverage_80 as candidate_interval_coverage, r.mae_improvement as recovery_mae_improvement, r.absolute_bias_improvement as recovery_bias_improvement, r.q95_upper_coverage as recovery_q95_coverage,
           l.state_macro_f1 as lifecycle_state_recovery, l.ladt_mae as lifecycle_ladt_mae, l.ladt_spearman as lifecycle_ladt_rank, (m.b_wape - m.a_wape) / (m.b_wape + 1e-9) as candidate_wape,
           p.wins as inventory_cost_win_rate, (k.a_total_cost - k.b_total_cost) / (k.b_total_cost + 1e-9) as inventory_cost_regression, k.b_fill_rate - k.a_fill_rate as inventory_fill_rate,
           m.a_mean_interval_width / (m.b_mean_interval_width + 1e-9) as candidate_interval_sharpness, s.worst as forecast_worst_slice, s.wins as forecast_slice_win_rate, y.a_repeat_stockout_ratio as closed_loop_stockout,
           (y.b_repeat_stockout_ratio - y.a_repeat_stockout_ratio) / (y.b_repeat_stockout_ratio + 1e-9) as closed_loop_stockout_improvement, (y.a_total_cost - y.b_total_cost) / (y.b_total_cost + 1e-9) as closed_loop_cost,
           (y.b_lost_sales - y.a_lost_sales) / (y.b_lost_sales + 1e-9) as closed_loop_lost_sales, z.worst_relative_cost_regression as closed_loop_worst_slice_cost, z.worst_fill_rate_degradation as closed_loop_worst_slice_fill
    from {{coverage}} c cross join {{node_error}} n cross join {{path_error}} e cross join (select sum(case when recovered_demand_mean + 1e-9 < sales then 1 else 0 end) as below from {{recovered}}) w
    cross join {{recovery}} r cross join {{path_scores}} x cross join {{lifecycle}} l cross join {{replay_slices}} z
    cross join {_pair('metrics', 'model', CANDIDATE, BASELINE, 'wape coverage_80 mean_interval_width')} m
    cross join {_pair('summary', 'model', CANDIDATE, BASELINE, 'total_cost fill_rate')} k
    cross join {_pair('replay', 'policy', AWARE, NAIVE, 'total_cost lost_sales repeat_stockout_ratio')} y
    cross join (select max(cost_win_rate_vs_baseline) as wins from {{policies}} where model = '{CANDIDATE}') p
    cross join (select coalesce(max(worst_relative_wape_regression), 0e0) as worst, coalesce(max(slice_win_rate), 1e0) as wins from {{slices}} where model = '{CANDIDATE}') s""")


def gate_step(overrides: dict[str, dict[str, float]] | None = None) -> Step:
    """A row for each check: its value, whether it holds (not where the value is missing), and the
    status of the whole: FAIL if a critical check fails, PASS if all hold, else ITERATE."""

    def sql(d: Dialect) -> str:
        rows = []
        for name, check in CHECKS.items():
            own = (overrides or {}).get(name, {})
            bounds = [f"value {sign} cast({bound!r} as double)" for sign, bound in ((">=", own.get("least", check.least)), ("<=", own.get("most", check.most))) if bound is not None]
            rows.append(f"select check_name, value, critical, case when value is not null and {' and '.join(bounds)} then 1 else 0 end as holds from (select '{name}' as check_name, cast({name} as double) as value, {int(check.critical)} as critical from {{values}}) v")
        return f"""
        with c as ({" union all ".join(rows)}), s as (select min(holds) as every, min(case when critical = 1 then holds else 1 end) as needed from c)
        select c.check_name, c.value, c.critical, c.holds, case when s.needed = 0 then 'FAIL' when s.every = 1 then 'PASS' else 'ITERATE' end as gate_status from c cross join s"""

    return Step(("values",), sql)
