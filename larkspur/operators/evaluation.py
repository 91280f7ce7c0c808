"""Forecast metrics, slices, routers and the hierarchy of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larkspur.functions.dialect import Dialect
from larkspur.plans.steps import Step

BASELINE = "seasonal_naive"
_WAPE = "sum(abs(q50 - demand)) / (sum(abs(demand)) + 1e-9)"
_PIN = "avg(greatest({p} * (demand - {q}), ({p} - 1e0) * (demand - {q}))) as pinball_{n}"
METRICS = f"""count(*) as n, {_WAPE} as wape, sum(q50 - demand) / (sum(abs(demand)) + 1e-9) as signed_bias,
  avg(case when demand between q10 and q90 then 1e0 else 0e0 end) as coverage_80, avg(q90 - q10) as mean_interval_width,
  {_PIN.format(p='1e-1', q='q10', n='10')}, {_PIN.format(p='5e-1', q='q50', n='50')}, {_PIN.format(p='9e-1', q='q90', n='90')}"""


def _demand(d: Dialect) -> str:
    """The demand of a forecast's day; a forecast without truth fails the query."""
    return d.refuse("t.series_id is null", "t.demand", "no truth for", "f.series_id", "f.date_idx")


def _metrics(d: Dialect) -> str:
    once = f"""(select series_id, date_idx, {d.refuse("count(*) > 1", "max(demand)", "several truths for", "series_id", "date_idx")} as demand from {{truth}} group by series_id, date_idx)"""
    return f"""
    select model, {METRICS} from (select f.model, f.q10, f.q50, f.q90, {_demand(d)} as demand from {{forecast}} f left join {once} t on t.series_id = f.series_id and t.date_idx = f.date_idx) j group by model"""


MODEL_METRICS = Step(("forecast", "truth"), _metrics)

DIMENSIONS = {"category": "category", "store": "store", "promotion": "promo", "stockout": "stockout", "demand_regime": "drat_state"}


def slice_step(min_rows: int = 8, candidate: str | None = None) -> Step:
    """Each model (or ``candidate``) against the baseline, slice by slice; dimensions are
    unpivoted, so that all slices are one aggregation."""

    def sql(d: Dialect) -> str:
        only = f"and c.model = '{candidate}'" if candidate else ""
        return f"""
        with j as (select f.model, f.q10, f.q50, f.q90, {_demand(d)} as demand, t.category, t.store, t.promo, t.stockout, t.drat_state from {{forecast}} f left join {{truth}} t on t.series_id = f.series_id and t.date_idx = f.date_idx),
        u as (select model, q10, q50, q90, demand, {d.unpivot(DIMENSIONS)} from j),
        s as (select dimension, slice_value, model, count(*) as n, {_WAPE} as wape, sum(q50 - demand) / (sum(abs(demand)) + 1e-9) as bias,
                     avg(case when demand between q10 and q90 then 1e0 else 0e0 end) as cover from u group by dimension, slice_value, model)
        select c.model, c.dimension, c.slice_value, c.n, c.wape as candidate_wape, b.wape as baseline_wape, (c.wape - b.wape) / greatest(b.wape, 1e-9) as relative_wape_regression,
               c.bias as candidate_signed_bias, b.bias as baseline_signed_bias, c.cover as candidate_coverage_80, b.cover as baseline_coverage_80
        from s c join s b on b.dimension = c.dimension and b.slice_value = c.slice_value
        where b.model = '{BASELINE}' and c.model <> '{BASELINE}' and c.n >= {min_rows} and b.n >= {min_rows} {only}"""

    return Step(("forecast", "truth"), sql)


#: A row for each model, and the baseline's, which is no regression against itself.
SLICE_SUMMARY = Step(("slices",), lambda d: f"""
    select model, count(*) as n_slices, max(relative_wape_regression) as worst_relative_wape_regression,
           {d.best("concat(dimension, '=', slice_value)", '-round(relative_wape_regression, 9)', 'dimension', 'slice_value')} as worst_slice,
           avg(case when relative_wape_regression <= 0 then 1e0 else 0e0 end) as slice_win_rate
    from {{slices}} group by model
    union all select '{BASELINE}' as model, 0 as n_slices, 0e0 as worst_relative_wape_regression, cast(null as string) as worst_slice, 1e0 as slice_win_rate""")


def _per_series(d: Dialect) -> str:
    return f"""select series_id, model, count(*) as n, {_WAPE} as wape from (select f.series_id, f.model, f.q50, {_demand(d)} as demand from {{forecast}} f
                   left join {{truth}} t on t.series_id = f.series_id and t.date_idx = f.date_idx) j group by series_id, model"""



def router_step(least: float = 0.05, min_rows: int = 14) -> Step:
    """The best model per series if it beats the baseline by enough on enough rows."""

    def sql(d: Dialect) -> str:
        return f"""
        with m as ({_per_series(d)}),
        b as (select series_id, {d.best('model', 'round(wape, 9)', 'model')} as best, min(wape) as best_wape, max(case when model = '{BASELINE}' then wape end) as base, max(case when model = '{BASELINE}' then n end) as n from m group by series_id),
        s as (select b.*, n >= {min_rows} and best <> '{BASELINE}' and (base - best_wape) / greatest(base, 1e-9) >= {least}e0 as better from b)
        select series_id, case when better then best else '{BASELINE}' end as selected_model, case when better then best_wape else base end as selected_wape, base as baseline_wape,
               (base - case when better then best_wape else base end) / greatest(base, 1e-9) as relative_improvement, n as n_validation_rows from s"""

    return Step(("forecast", "truth"), sql)


def decision_router_step(regression: float = 0.10, min_rows: int = 14) -> Step:
    """The cheapest model per series among those whose error is near the baseline's or below."""

    def sql(d: Dialect) -> str:
        return f"""
        with m as ({_per_series(d)}),
        c as (select series_id, model, sum(cost) as cost from {{simulation}} group by series_id, model),
        j as (select m.series_id, m.model, m.n, m.wape, c.cost, max(case when m.model = '{BASELINE}' then wape end) over (partition by m.series_id) as base,
                     max(case when m.model = '{BASELINE}' then n end) over (partition by m.series_id) as base_n, max(case when m.model = '{BASELINE}' then cost end) over (partition by m.series_id) as base_cost
              from m join c on c.series_id = m.series_id and c.model = m.model),
        e as (select * from j where model = '{BASELINE}' or (base_n >= {min_rows} and wape <= base * {1 + regression}e0)),
        r as (select e.*, row_number() over (partition by series_id order by round(cost, 9), round(wape, 9), model) as place from e)
        select series_id, model as selected_model, wape as selected_wape, base as baseline_wape, (base - wape) / greatest(base, 1e-9) as relative_improvement, base_n as n_validation_rows,
               cost as selected_cost, base_cost as baseline_cost, (base_cost - cost) / greatest(base_cost, 1e-9) as relative_cost_improvement,
               'lowest_validation_cost_within_wape_guardrail' as routing_reason from r where place = 1"""

    return Step(("forecast", "truth", "simulation"), sql)



def _routed(d: Dialect) -> str:
    decided = d.refuse("r.series_id is null", "r.selected_model", "no routing decision for", "f.series_id")
    return f"""
    with r as (select series_id, {d.refuse("count(*) > 1", "max(selected_model)", "several routing decisions for", "series_id")} as selected_model from {{routing}} group by series_id),
    j as (select f.*, {decided} as chosen from {{forecast}} f left join r on r.series_id = f.series_id),
    k as (select j.*, max(case when model = chosen then 1 else 0 end) over (partition by series_id, date_idx) as available from j)
    select series_id, origin, date_idx, horizon, q10, q50, q90, 'reliability_router' as model, model as routed_from_model
    from k where {d.refuse("available = 0", "model = chosen", "the routed model has no forecast for", "series_id", "date_idx")}"""


#: Forecasts of each series' chosen model. A series without a decision, or with several, and a day without
#: the chosen model's forecast fail the query.
ROUTED = Step(("forecast", "routing"), _routed)

#: Counts and means of each selected model's series (own_), and those over all series.
ROUTING_SUMMARY = Step(("routing",), lambda d: f"""
    with m as (select selected_model, count(*) as n_series, sum(relative_improvement) as w, sum(relative_cost_improvement) as c, avg(relative_improvement) as own_w, avg(relative_cost_improvement) as own_c from {{routing}} group by selected_model)
    select selected_model, n_series, own_w as own_validation_improvement, own_c as own_validation_cost_improvement, sum(n_series) over () as all_series,
           sum(w) over () / sum(n_series) over () as mean_validation_improvement, sum(c) over () / sum(n_series) over () as mean_validation_cost_improvement,
           sum(case when selected_model = '{BASELINE}' then n_series else 0 end) over () * 1e0 / sum(n_series) over () as fallback_rate
    from m""")


def _nodes(keys: str, sums: str, own: str) -> Step:
    def sql(d: Dialect) -> str:
        known = lambda c: d.refuse(f"m.{c} is null", f"m.{c}", "no hierarchy metadata for", "f.series_id")
        return f"""
        with m as (select series_id, max(category) as category, max(store) as store from {{metadata}} group by series_id),
        j as (select f.*, {known('category')} as category, {known('store')} as store from {{forecast}} f left join m on m.series_id = f.series_id),
        g as (select {keys}, store, category, grouping(store) as gs, grouping(category) as gc, {sums} from j
              group by grouping sets (({keys}, store), ({keys}, category), ({keys}, store, category), ({keys}))),
        n as (select {keys}, case when gs = 0 and gc = 0 then concat('store_category:', store, '|', category) when gs = 0 then concat('store:', store) when gc = 0 then concat('category:', category) else 'total' end as node_id,
               case when gs = 0 and gc = 0 then 'store_category' when gs = 0 then 'store' when gc = 0 then 'category' else 'total' end as level,
               coalesce(category, 'ALL') as category, coalesce(store, 'ALL') as store, {own} from g)
        select {keys}, node_id, node_id as series_id, level, category, store, {own} from n
        union all select {keys}, series_id as node_id, series_id, 'bottom' as level, category, store, {own} from j"""

    return Step(("forecast", "metadata"), sql)


#: Nodes of five levels; a series without category or store fails the query.
POINT_NODES = _nodes("model, origin, date_idx, horizon", "sum(q10) as q10, sum(q50) as q50, sum(q90) as q90", "q10, q50, q90")
PATH_NODES = _nodes("model, scenario, date_idx, horizon", "sum(demand) as demand", "demand")

#: The total of each day against the forecasts themselves; a total without forecasts, or the reverse, counts whole.
NODE_ERROR = Step(("nodes", "forecast"), lambda d: """
    with t as (select model, origin, date_idx, q10, q50, q90 from {nodes} where level = 'total' union all select model, origin, date_idx, -q10, -q50, -q90 from {forecast}),
    k as (select model, origin, date_idx, abs(sum(q10)) as e10, abs(sum(q50)) as e50, abs(sum(q90)) as e90 from t group by model, origin, date_idx)
    select coalesce(max(greatest(e10, e50, e90)), 0e0) as hierarchy_max_error from k""")


def forecast_metrics(forecast: DataFrame, truth: DataFrame) -> DataFrame:
    return MODEL_METRICS.run(forecast=forecast, truth=truth)


def forecast_slices(forecast: DataFrame, truth: DataFrame, min_rows: int = 8, candidate: str | None = None) -> DataFrame:
    return slice_step(min_rows, candidate).run(forecast=forecast, truth=truth)


def summarize_slices(slices: DataFrame) -> DataFrame:
    return SLICE_SUMMARY.run(slices=slices)


def learn_series_router(forecast: DataFrame, truth: DataFrame, least: float = 0.05, min_rows: int = 14) -> DataFrame:
    return router_step(least, min_rows).run(forecast=forecast, truth=truth)


def learn_decision_router(forecast: DataFrame, truth: DataFrame, simulation: DataFrame, regression: float = 0.10, min_rows: int = 14) -> DataFrame:
    return decision_router_step(regression, min_rows).run(forecast=forecast, truth=truth, simulation=simulation)


def apply_series_router(forecast: DataFrame, routing: DataFrame) -> DataFrame:
    return ROUTED.run(forecast=forecast, routing=routing)


def reconcile_bottom_up(forecast: DataFrame, metadata: DataFrame) -> DataFrame:
    """All nodes of the five levels from one pass of grouping sets."""
    return POINT_NODES.run(forecast=forecast, metadata=metadata)


def reconcile_paths(scenarios: DataFrame, metadata: DataFrame) -> DataFrame:
    return PATH_NODES.run(forecast=scenarios, metadata=metadata)
