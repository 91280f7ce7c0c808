"""Inventory simulation as an ordered fold per model, series and scale; scenario paths; marts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from larkspur.functions.dialect import Dialect
from larkspur.plans.steps import Step

from .evaluation import BASELINE

SCALES = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00, 1.05, 1.10)


@dataclass(frozen=True)
class InventoryConfig:
    holding: float = 1.0
    shortage: float = 5.0
    order: float = 0.1
    lead: int = 2
    review: int = 1
    service: float = 0.80
    initial: float = 1.0
    capacity: float | None = None

    @property
    def protection(self) -> int:
        return max(1, self.lead + self.review)


def service_quantile(level: float) -> str:
    """SQL of a quantile between the anchors 0.1, 0.5 and 0.9, linear beyond the last."""
    level = min(max(level, 0.0), 1.0)
    if level <= 0.1:
        return f"greatest(0e0, q10 * {level / 0.1!r}e0)"
    if level <= 0.9:
        low, high, at = ("q10", "q50", 0.1) if level <= 0.5 else ("q50", "q90", 0.5)
        return f"({low} + {(level - at) / 0.4:.15f}e0 * ({high} - {low}))"
    return f"greatest(0e0, q90 + {level - 0.9:.15f}e0 * (q90 - q50) / 4e-1)"


def quantile_step(level: float) -> Step:
    return Step(("forecast",), lambda d: f"select model, series_id, origin, date_idx, horizon, {service_quantile(level)} as service_quantile from {{forecast}}")


def initial_step(cfg: InventoryConfig) -> Step:
    """Opening stock per series, the same for all models: the baseline's first protection period."""

    def sql(d: Dialect) -> str:
        return f"""
        with s as (select series_id, date_idx, max(case when model = '{BASELINE}' then {service_quantile(cfg.service)} end) as own, {d.quantile(service_quantile(cfg.service))} as middle from {{forecast}} group by series_id, date_idx),
        r as (select s.*, row_number() over (partition by series_id order by date_idx) as nr from s)
        select series_id, greatest(0e0, {cfg.initial}e0 * sum(coalesce(own, middle))) as initial_inventory from r where nr <= {cfg.protection} group by series_id"""

    return Step(("forecast",), sql)


def _prepared(d: Dialect, cfg: InventoryConfig, scales: tuple[float, ...]) -> tuple[str, str]:
    w = f"over (partition by f.model, f.series_id order by f.date_idx rows between 1 following and {cfg.protection} following)"
    grid = " union all ".join(f"select {s}e0 as policy_scale" for s in scales)
    return f"""
        select f.model, f.series_id, f.date_idx, {d.refuse("t.series_id is null", "t.demand", "no truth for", "f.series_id", "f.date_idx")} as demand,
               {d.refuse("i.series_id is null", "i.initial_inventory", "no initial inventory for", "f.series_id")} as initial_inventory, row_number() over (partition by f.model, f.series_id order by f.date_idx) - 1 as idx,
               case when count(*) {w} = {cfg.protection} then sum({service_quantile(cfg.service)}) {w} end as base_target
        from {{forecast}} f left join {{truth}} t on t.series_id = f.series_id and t.date_idx = f.date_idx left join {{initial}} i on i.series_id = f.series_id""", grid


def open_loop_step(cfg: InventoryConfig, scales: tuple[float, ...] = (1.0,)) -> Step:
    """One fold over the days of each (model, series, scale): the state is stock on hand and a list
    of open orders, each with the day on which it arrives."""

    def sql(d: Dialect) -> str:
        rows, grid = _prepared(d, cfg, scales)
        cap = f"least({cfg.capacity}e0, " if cfg.capacity is not None else "("
        if d.spark:
            day = "struct<date_idx:int,opening:double,arrivals:double,demand:double,sales:double,lost:double,ending:double,position:double,target:double,eligible:int,review:int,order_qty:double,open_qty:double>"
            lead = f"if(y.o > 0, array(struct(cast(x.date_idx + {cfg.lead} as int) as due, y.o as qty)), array())" if cfg.lead else "array()"
            total = "aggregate({}, 0e0, (s, o) -> s + o.qty)"
            return f"""
            with p as ({rows}), g as (select p.*, policy_scale, policy_scale * base_target as target from p cross join ({grid}) s),
            l as (select model, series_id, policy_scale, max(initial_inventory) as initial_inventory,
                         array_sort(collect_list(struct(cast(date_idx as int) as date_idx, demand, target, idx))) as days from g group by model, series_id, policy_scale),
            f as (select model, series_id, policy_scale, initial_inventory, aggregate(days,
              named_struct('hand', initial_inventory, 'open', cast(array() as array<struct<due:int,qty:double>>), 'out', cast(array() as array<{day}>)),
              (a, x) -> transform(array(named_struct('arr', {total.format('filter(a.open, o -> o.due <= x.date_idx)')}, 'open', filter(a.open, o -> o.due > x.date_idx))), b ->
                transform(array(named_struct('h', a.hand + b.arr, 'w', {total.format('b.open')}, 'r', if(x.idx % {cfg.review} = 0 and x.target is not null, 1, 0))), c ->
                  transform(array(named_struct('o', if(c.r = 1, {cap}greatest(0e0, x.target - (greatest(c.h - x.demand, 0e0) + c.w))), 0e0), 'e', greatest(c.h - least(c.h, x.demand), 0e0))), y ->
                    named_struct('hand', y.e + if({cfg.lead} = 0, y.o, 0e0),
                      'open', cast(concat(b.open, {lead}) as array<struct<due:int,qty:double>>),
                      'out', array_append(a.out, cast(struct(x.date_idx, c.h, b.arr, x.demand, least(c.h, x.demand), greatest(0e0, x.demand - c.h), y.e + if({cfg.lead} = 0, y.o, 0e0),
                         greatest(c.h - x.demand, 0e0) + c.w, x.target, if(x.target is null, 0, 1), c.r, y.o, c.w + if({cfg.lead} = 0, 0e0, y.o)) as {day}))))[0])[0])[0],
              a -> a.out) as o from l),
            r as (select model, series_id, policy_scale, initial_inventory, inline(o) from f)
            select model, series_id, date_idx, initial_inventory, opening as opening_inventory, arrivals, demand, sales, lost as lost_sales, ending as ending_inventory, position as inventory_position,
                   target as target_inventory_position, eligible as decision_eligible, review as is_review_period, order_qty, open_qty as open_order_qty, case when lost > 1e-9 then 1 else 0 end as stockout,
                   {cfg.holding}e0 * ending + {cfg.shortage}e0 * lost + {cfg.order}e0 * order_qty as cost, policy_scale from r"""
        if (cfg.lead, cfg.review) != (2, 1):
            raise NotImplementedError("the recursive form carries two pending orders")
        ending, target = "greatest(f.ending + f.o1 - n.demand, 0e0)", "n.policy_scale * n.base_target"
        position = f"({ending} + f.o0)"
        order = f"case when n.base_target is not null then {cap}greatest(0e0, {target} - {position})) else 0e0 end"
        first = "greatest(n.initial_inventory - n.demand, 0e0)"
        first_order = f"case when n.base_target is not null then {cap}greatest(0e0, {target} - {first})) else 0e0 end"
        return f"""
        with recursive p as ({rows}), n as (select p.*, policy_scale from p cross join ({grid}) s),
        f as (select n.model, n.series_id, n.policy_scale, n.idx, n.date_idx, n.initial_inventory, n.initial_inventory as opening, 0e0 as arrivals, n.demand, least(n.initial_inventory, n.demand) as sales,
                     greatest(0e0, n.demand - n.initial_inventory) as lost, {first} as ending, {first} as position, {target} as target, {first_order} as o0, 0e0 as o1 from n where idx = 0
              union all
              select n.model, n.series_id, n.policy_scale, n.idx, n.date_idx, n.initial_inventory, f.ending + f.o1, f.o1, n.demand, least(f.ending + f.o1, n.demand), greatest(0e0, n.demand - f.ending - f.o1),
                     {ending}, {position}, {target}, {order}, f.o0 from f join n on n.model = f.model and n.series_id = f.series_id and n.policy_scale = f.policy_scale and n.idx = f.idx + 1)
        select model, series_id, date_idx, initial_inventory, opening as opening_inventory, arrivals, demand, sales, lost as lost_sales, ending as ending_inventory, position as inventory_position,
               target as target_inventory_position, case when target is null then 0 else 1 end as decision_eligible, case when target is null then 0 else 1 end as is_review_period, o0 as order_qty, o0 + o1 as open_order_qty,
               case when lost > 1e-9 then 1 else 0 end as stockout, {cfg.holding}e0 * ending + {cfg.shortage}e0 * lost + {cfg.order}e0 * o0 as cost, policy_scale from f"""

    return Step(("forecast", "truth", "initial"), sql)


_KPI = """sum(cost) as total_cost, sum(lost_sales) as lost_sales, 1e0 - sum(lost_sales) / (sum(demand) + 1e-9) as fill_rate, avg(stockout) as stockout_rate, avg(ending_inventory) as average_inventory"""

#: KPIs by model and scale; they compare only if all were simulated on the same demand, else the query fails.
SUMMARY = Step(("simulation",), lambda d: f"""
    with v as (select model, policy_scale, avg(coalesce(s, 0e0)) as order_volatility from (select model, policy_scale, series_id, stddev_samp(order_qty) as s from {{simulation}} group by model, policy_scale, series_id) x group by model, policy_scale),
    s as (select model, policy_scale, {_KPI}, sum(demand) as demand from {{simulation}} group by model, policy_scale),
    w as (select s.*, max(demand) over () as most, min(demand) over () as least from s),
    k as (select model, policy_scale, {d.refuse("most - least > 1e-9 * abs(most) + 1e-8", "total_cost", "models were simulated on different demand:", "model", "policy_scale")} as total_cost, lost_sales, fill_rate, stockout_rate, average_inventory from w)
    select k.*, v.order_volatility from k join v on v.model = k.model and v.policy_scale = k.policy_scale""")

TUNING = Step(("summary",), lambda d: f"""
    select s.*, fill_rate >= (select max(fill_rate) from {{summary}} where model = '{BASELINE}' and policy_scale = 1e0) - 1e-2 as meets_fill_guardrail from {{summary}} s""")

#: Of a simulation over a grid of scales, the runs of each model at its chosen one.
AT_BEST_SCALE = Step(("grid", "best"), lambda d: "select g.* from {grid} g join {best} b on b.model = g.model and b.policy_scale = g.policy_scale")

BEST_POLICY = Step(("tuning",), lambda d: f"""
    with b as (select fill_rate from (select fill_rate, row_number() over (order by case when meets_fill_guardrail then 0 else 1 end, round(total_cost, 9), policy_scale) as r from {{tuning}} where model = '{BASELINE}') x where r = 1),
    f as (select t.*, b.fill_rate as baseline_fill_rate, t.fill_rate >= b.fill_rate as feasible from {{tuning}} t cross join b),
    r as (select f.*, row_number() over (partition by model order by case when feasible then 0 else 1 end, round(total_cost, 9), policy_scale) as place from f)
    select model, total_cost, lost_sales, fill_rate, stockout_rate, average_inventory, order_volatility, policy_scale, baseline_fill_rate, baseline_fill_rate - fill_rate as fill_rate_degradation_vs_baseline,
           case when feasible then 1e0 else 0e0 end as meets_service_guardrail from r where place = 1""")

WIN_RATE = Step(("simulation",), lambda d: f"""
    with c as (select series_id, model, sum(cost) as cost from {{simulation}} where policy_scale = 1e0 group by series_id, model)
    select c.model, avg(case when {d.at_most('c.cost', 'b.cost')} then 1e0 else 0e0 end) as cost_win_rate_vs_baseline, count(*) as n_series from c join c b on b.series_id = c.series_id and b.model = '{BASELINE}' group by c.model""")

KPI_MART = Step(("simulation",), lambda d: """
    select model, series_id, count(*) as evaluated_days, sum(demand) as total_demand, sum(sales) as total_sales, sum(lost_sales) as total_lost_sales, sum(cost) as total_cost,
           avg(ending_inventory) as average_inventory, avg(stockout) as stockout_rate, 1e0 - sum(lost_sales) / nullif(sum(demand), 0e0) as fill_rate
    from {simulation} where policy_scale = 1e0 group by model, series_id""")

DAILY_MART = Step(("panel", "regimes"), lambda d: """
    select p.series_id, p.date_idx, p.category, p.store, p.sales, p.demand, p.stockout, p.promo, p.price, p.recovered_demand_mean, r.drat_state, r.drat_entropy,
           lag(p.sales, 1) over (partition by p.series_id order by p.date_idx) as sql_lag_1,
           avg(p.sales) over (partition by p.series_id order by p.date_idx rows between 7 preceding and 1 preceding) as sql_roll_mean_7
    from {panel} p join {regimes} r on r.series_id = p.series_id and r.date_idx = p.date_idx""")


def paths_step(n: int = 120, rho: float = 0.65, seed: int = 42) -> Step:
    """AR(1) shocks between the anchors, from hash-keyed normals: in Spark a fold over the horizons of a path, in
    the oracle the weighted sum of the path's innovations up to each day."""

    def sql(d: Dialect) -> str:
        inner = (1 - rho * rho) ** 0.5
        if d.spark:
            # A forecast's horizons stay together, so paths are folded in their row: nothing of theirs is shuffled, no power of rho vanishes.
            noise = d.normal(str(seed), "model", "series_id", "scenario", "h.horizon")
            return f"""
        with l as (select model, series_id, origin, array_sort(collect_list(struct(horizon, date_idx, q10, q50, q90))) as hs from {{forecast}} group by model, series_id, origin),
        s as (select l.*, {d.series(0, n - 1)} as scenario from l),
        f as (select model, series_id, scenario, hs, aggregate(transform(hs, h -> {noise}), cast(array() as array<double>), (a, e) -> array_append(a, if(size(a) = 0, e, {rho}e0 * element_at(a, -1) + {inner!r}e0 * e))) as xs from s),
        r as (select model, series_id, scenario, xs, posexplode(hs) as (i, h) from f),
        w as (select model, series_id, scenario, h.date_idx, h.horizon, h.q10, h.q50, h.q90, xs[i] as x from r)
        select model, series_id, scenario, date_idx, horizon, greatest(0e0, q50 + x * greatest(1e-6, case when x < 0 then q50 - q10 else q90 - q50 end / 12815515655446004e-16)) as demand,
               q10 as q10_forecast, q50 as median_forecast, q90 as q90_forecast, greatest(5e-1, q90 - q10) as interval_scale from w"""
        return f"""
        with s as (select f.*, {d.series(0, n - 1)} as scenario from {{forecast}} f),
        z as (select s.*, {d.normal(str(seed), 'model', 'series_id', 'scenario', 'horizon')} as e from s),
        w as (select z.*, power({rho}e0, cast(horizon as double)) * sum(case when horizon = 1 then e else {inner!r}e0 * e end / power({rho}e0, cast(horizon as double))) over (partition by model, series_id, origin, scenario order by horizon rows between unbounded preceding and current row) as x from z)
        select model, series_id, scenario, date_idx, horizon, greatest(0e0, q50 + x * greatest(1e-6, case when x < 0 then q50 - q10 else q90 - q50 end / 12815515655446004e-16)) as demand,
               q10 as q10_forecast, q50 as median_forecast, q90 as q90_forecast, greatest(5e-1, q90 - q10) as interval_scale from w"""

    return Step(("forecast",), sql)


PATH_DIAGNOSTICS = Step(("scenarios",), lambda d: f"""
    with v as (select model, series_id, scenario, horizon, demand, (demand - median_forecast) / interval_scale as x from {{scenarios}}),
    l as (select v.*, lag(x) over (partition by model, series_id, scenario order by horizon) as y from v),
    c as (select model, series_id, scenario, case when count(y) > 1 and stddev_pop(case when y is not null then x end) > 1e-12 and stddev_pop(y) > 1e-12 then corr(y, x) end as r from l group by model, series_id, scenario),
    q as (select model, series_id, date_idx, abs({d.quantile('demand', 0.1)} - min(q10_forecast)) / greatest(min(interval_scale), 1e0) as e1, abs({d.quantile('demand', 0.5)} - min(median_forecast)) / greatest(min(interval_scale), 1e0) as e2,
                 abs({d.quantile('demand', 0.9)} - min(q90_forecast)) / greatest(min(interval_scale), 1e0) as e3 from {{scenarios}} group by model, series_id, date_idx)
    select (select count(distinct scenario) from {{scenarios}}) as n_scenarios, (select coalesce(avg(r), 0e0) from c) as mean_lag1_correlation,
           (select count(*) from {{scenarios}} where demand < 0) as negative_values, (select (avg(e1) + avg(e2) + avg(e3)) / 3e0 from q) as normalized_quantile_mae""")


def common_initial_inventory(forecast: DataFrame, cfg: InventoryConfig = InventoryConfig()) -> DataFrame:
    return initial_step(cfg).run(forecast=forecast)


def run_open_loop(forecast: DataFrame, truth: DataFrame, initial: DataFrame, cfg: InventoryConfig = InventoryConfig(), scales: tuple[float, ...] = (1.0,)) -> DataFrame:
    return open_loop_step(cfg, tuple(scales)).run(forecast=forecast, truth=truth, initial=initial)


def summarize_inventory(simulation: DataFrame) -> DataFrame:
    return SUMMARY.run(simulation=simulation)


def generate_scenarios(forecast: DataFrame, n: int = 120, rho: float = 0.65, seed: int = 42) -> DataFrame:
    return paths_step(n, rho, seed).run(forecast=forecast)
