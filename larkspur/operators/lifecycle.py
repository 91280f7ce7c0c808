"""Demand-regime features, lifecycle states and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larkspur.functions.dialect import Dialect
from larkspur.plans.steps import Step, checkpointed

REGIMES = ("accelerating", "stable", "decelerating", "intermittent")
#: First position and width of each lifecycle state on the 0..1 clock.
CLOCK = {"intro": (0.0, 0.18), "growth": (0.18, 0.24), "mature": (0.42, 0.30), "decline": (0.72, 0.18), "dormant": (0.90, 0.10), "reactivation": (0.55, 0.20)}


def regime_step(value: str) -> Step:
    def sql(d: Dialect) -> str:
        o = "over (partition by series_id order by date_idx"
        f = lambda x, w, k: f"case when count(past) {o} rows between {w - 1} preceding and current row) >= {k} then {x} {o} rows between {w - 1} preceding and current row) end"
        p = "(p0 + p1 + p2 + p3 + 1e-12)"
        share = [f"p{k} / {p}" for k in range(4)]
        top = "greatest(l0, l1, l2, l3)"
        return f"""
        with a as (select t.*, coalesce(lag({value}) {o}), 0e0) as past from {{panel}} t),
        b as (select a.*, coalesce({f('avg(past)', 7, 2)}, past) as short, {f('avg(past)', 28, 3)} as long0,
                     coalesce({f('avg(case when past = 0 then 1e0 else 0e0 end)', 14, 2)}, 0e0) as zeros, coalesce({f('stddev_samp(past)', 14, 3)}, 0e0) as vol from a),
        c as (select b.*, coalesce(long0, short) as long1 from b),
        e as (select c.*, least(greatest((short - long1) / (abs(long1) + 1e0), -3e0), 3e0) as slope, least(greatest(vol / (abs(long1) + 1e0), 0e0), 3e0) as nvol from c),
        g as (select e.*, 5e0 * slope - 5e-1 * nvol as l0, -4e0 * abs(slope) - 6e-1 * nvol + 12e-1 as l1, -5e0 * slope - 5e-1 * nvol as l2, 5e0 * zeros - 1e0 as l3 from e),
        h as (select g.*, {', '.join(f'exp(greatest(l{k} - {top}, -40e0)) as p{k}' for k in range(4))} from g),
        i as (select h.*, {', '.join(f'{share[k]} as drat_{REGIMES[k]}' for k in range(4))},
                     case when l0 = {top} then 'accelerating' when l1 = {top} then 'stable' when l2 = {top} then 'decelerating' else 'intermittent' end as drat_state from h),
        j as (select i.*, case when drat_state = lag(drat_state) {o}) then 0 else 1 end as changed from i),
        k as (select j.*, sum(changed) {o} rows between unbounded preceding and current row) as island from j)
        select series_id, date_idx, sales, demand, stockout, price, promo, category, store, dow, {value} as level_value, {', '.join(f'drat_{r}' for r in REGIMES)},
               least(greatest(-({' + '.join(f'drat_{r} * ln(drat_{r} + 1e-12)' for r in REGIMES)}) / ln(4e0), 0e0), 1e0) as drat_entropy, slope as drat_velocity, drat_state,
               1e0 - exp(-(row_number() over (partition by series_id, island order by date_idx) - 1) / 21e0) as drat_progress
        from k"""

    return Step(("panel",), sql)


def _states(d: Dialect) -> str:
    o = "over (partition by series_id order by date_idx"
    clock = lambda k: "case state " + " ".join(f"when '{s}' then {v[k]}e0" for s, v in CLOCK.items()) + " end"
    return f"""
    with a as (select p.*, lag(sales) {o}) as past_level, max(sales) {o} rows between unbounded preceding and 1 preceding) as peak, row_number() {o}) - 1 as age from {{panel}} p),
    b as (select a.*, least(greatest(coalesce(past_level / nullif(peak, 0), 0e0), 0e0), 15e-1) as ratio from a),
    c as (select b.*, case when count(ratio) {o} rows between 21 preceding and 1 preceding) >= 5 then min(ratio) {o} rows between 21 preceding and 1 preceding) else 1e0 end as low from b),
    e as (select c.*, low < 28e-2 and ratio > 24e-2 and drat_accelerating > 38e-2 and drat_velocity > 2e-2 and age >= 14 as back from c),
    f as (select e.*, case when back then 'reactivation' when ratio < 24e-2 and age > 35 then 'dormant'
                           when ratio between 24e-2 and 88e-2 and drat_decelerating > 34e-2 and drat_velocity < -15e-3 then 'decline'
                           when drat_accelerating > 34e-2 and drat_velocity > 12e-3 and age >= 14 then 'growth' when age < 14 then 'intro' else 'mature' end as state from e)
    select series_id, date_idx, sales, drat_state, drat_velocity, drat_progress, state as estimated_lifecycle_state,
           least(greatest({clock(0)} + {clock(1)} * drat_progress, 0e0), 1e0) as estimated_ladt
    from f"""


STATES = Step(("panel",), _states)


def benchmark_step(n_series: int = 18, days: int = 168, seed: int = 42) -> Step:
    """Panels with a known lifecycle: five phases of series-dependent lengths, the last one a
    reactivation in every fourth series and dormant in the others."""

    def sql(d: Dialect) -> str:
        u = lambda s: d.uniform(str(seed), f"'{s}'", "series_id")
        return f"""
        with s as (select concat('life_', cast(n as string)) as series_id, n from (select {d.series(0, n_series - 1)} as n) x),
        b as (select s.*, 14 + floor(6 * {u('a')}) as d1, 30 + floor(12 * {u('b')}) as d2, 40 + floor(16 * {u('c')}) as d3, 30 + floor(12 * {u('e')}) as d4, 12e0 + 18e0 * {u('f')} as base from s),
        g as (select b.*, {d.series(0, days - 1)} as date_idx from b),
        p as (select g.*, case when date_idx < d1 then 'intro' when date_idx < d1 + d2 then 'growth' when date_idx < d1 + d2 + d3 then 'mature' when date_idx < d1 + d2 + d3 + d4 then 'decline'
                               when n % 4 = 3 then 'reactivation' else 'dormant' end as state from g),
        q as (select p.*, case state when 'intro' then date_idx / d1 when 'growth' then (date_idx - d1) / d2 when 'mature' then (date_idx - d1 - d2) / d3
                               when 'decline' then (date_idx - d1 - d2 - d3) / d4 else (date_idx - d1 - d2 - d3 - d4) / ({days} - d1 - d2 - d3 - d4) end as x from p),
        l as (select q.*, base * case state when 'intro' then 15e-2 + 1e-1 * x when 'growth' then 25e-2 + 75e-2 * x when 'mature' then 1e0 when 'decline' then 1e0 - 75e-2 * x
                               when 'reactivation' then 1e-1 + 8e-1 * x else 8e-2 end as level, {d.normal(str(seed), "'z'", 'series_id', 'date_idx')} as z from q)
        select series_id, date_idx, round(greatest(level * (1e0 + 8e-2 * z), 0e0), 4) as sales, round(greatest(level * (1e0 + 8e-2 * z), 0e0), 4) as demand, 0 as stockout, 1e0 as price, 0 as promo,
               'life' as category, 'life' as store, cast(date_idx % 7 as int) as dow, state as true_lifecycle_state,
               case state {' '.join(f"when '{k}' then {v[0]}e0 + {v[1]}e0 * x" for k, v in CLOCK.items())} end as true_ladt
        from l"""

    return Step((), sql)


def _scores(d: Dialect) -> str:
    return """
    with m as (select b.series_id, b.date_idx, true_lifecycle_state as t, true_ladt as y, estimated_lifecycle_state as e, estimated_ladt as z
               from {truth} b join {estimate} x on b.series_id = x.series_id and b.date_idx = x.date_idx),
    l as (select t as label from m union select e from m),
    f as (select label, sum(case when t = label and e = label then 1 else 0 end) as tp, sum(case when t <> label and e = label then 1 else 0 end) as fp, sum(case when t = label and e <> label then 1 else 0 end) as fn
          from l cross join m group by label),
    r as (select rank() over (order by y) + (count(*) over (partition by y) - 1) / 2e0 as ry, rank() over (order by z) + (count(*) over (partition by z) - 1) / 2e0 as rz from m)
    select (select count(*) from m) as n, (select avg(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0)) from f) as state_macro_f1,
           (select avg(abs(y - z)) from m) as ladt_mae, (select corr(ry, rz) from r) as ladt_spearman"""


def _scores_by_counts(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """Labels meet in one table of counts, and mean ranks come from running sums of the counts of values."""
    from pyspark.sql import functions as F

    from .ranks import ordered

    m = truth.select("series_id", "date_idx", F.col("true_lifecycle_state").alias("t"), F.col("true_ladt").alias("y")).join(
        estimate.select("series_id", "date_idx", F.col("estimated_lifecycle_state").alias("e"), F.col("estimated_ladt").alias("z")), ["series_id", "date_idx"]
    )
    m = checkpointed(m)
    sides = "stack(2, t, if(t = e, c, 0L), 0L, if(t <> e, c, 0L), e, 0L, if(t <> e, c, 0L), 0L) as (label, tp, fp, fn)"
    by_label = m.groupBy("t", "e").agg(F.count(F.lit(1)).alias("c")).selectExpr(sides).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    f1 = by_label.agg(F.expr("avg(coalesce(2D * tp / nullif(2 * tp + fp + fn, 0), 0D))").alias("state_macro_f1"))
    ranked = m
    for c in ("y", "z"):
        counts = m.groupBy(c).agg(F.count(F.lit(1)).alias("c"))
        ranks = ordered(counts, [c], "before", weight="c").select(F.col(c).alias(f"_{c}"), F.expr("before + (c + 1) / 2D").alias(f"r{c}"))
        ranked = ranked.join(ranks, F.col(c).eqNullSafe(F.col(f"_{c}")))
    rest = ranked.agg(F.count(F.lit(1)).alias("n"), F.expr("avg(abs(y - z))").alias("ladt_mae"), F.corr("ry", "rz").alias("ladt_spearman"))
    return rest.crossJoin(f1).select("n", "state_macro_f1", "ladt_mae", "ladt_spearman")


SCORES = Step(("truth", "estimate"), _scores, _scores_by_counts)


def add_regimes(panel: DataFrame, value: str = "recovered_demand_mean") -> DataFrame:
    return regime_step(value if value in panel.columns else "sales").run(panel=panel)


def estimate_lifecycle(regimes: DataFrame) -> DataFrame:
    return STATES.run(panel=regimes)


def lifecycle_metrics(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """Macro F1 over all labels, mean absolute error and rank correlation of the clock."""
    return SCORES.run(truth=truth, estimate=estimate)
