"""Controlled stockout censoring, latent-demand recovery, posterior draws and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larkspur.functions.dialect import Dialect
from larkspur.plans.steps import Step


def controlled_stockouts(seed: int = 42, rate: float = 0.12) -> Step:
    """Random, promotion- and surge-driven censoring; the truth is kept beside."""

    def sql(d: Dialect) -> str:
        return f"""
        with r as (select p.*, greatest(coalesce({d.quantile('demand')} over (partition by series_id order by date_idx rows between 28 preceding and 1 preceding), demand), 1e-1) as ref,
                          {d.uniform(str(seed), '1', 'series_id', 'date_idx')} as u1, {d.uniform(str(seed), '2', 'series_id', 'date_idx')} as u2 from {{panel}} p),
        m as (select r.*, case when u1 < least(greatest({rate}e0 + 16e-2 * promo + 12e-2 * case when demand > 125e-2 * ref then 1 else 0 end, 0e0), 75e-2) and demand > 0 then 1 else 0 end as hit from r)
        select series_id, date_idx, case when hit = 1 then least(sales, demand * (35e-2 + 47e-2 * u2)) else sales end as sales, demand,
               case when hit = 1 then 1 else stockout end as stockout, price, promo, category, store, dow, demand as controlled_true_demand, hit as controlled_stockout
        from m"""

    return Step(("panel",), sql)


def _recover(d: Dialect) -> str:
    w = "over (partition by series_id order by date_idx rows between {} preceding and 1 preceding)"
    enough = lambda x, k, n: f"case when count(sales) {w.format(n)} >= {k} then {x} {w.format(n)} end"
    return f"""
    with b as (select c.*, lag(sales, 7) over (partition by series_id order by date_idx) as lag7, {enough(d.quantile('sales'), 3, 14)} as med14,
                      {enough('avg(sales)', 4, 28)} as mean28, {enough('stddev_samp(sales)', 4, 28)} as std28 from {{panel}} c),
    m as (select b.*, case when lag7 is null and med14 is null and mean28 is null then sales
                           when lag7 is not null and med14 is not null and mean28 is not null then lag7 + med14 + mean28 - greatest(lag7, med14, mean28) - least(lag7, med14, mean28)
                           else (coalesce(lag7, 0e0) + coalesce(med14, 0e0) + coalesce(mean28, 0e0))
                                / nullif(case when lag7 is null then 0 else 1 end + case when med14 is null then 0 else 1 end + case when mean28 is null then 0 else 1 end, 0) end as baseline from b),
    r as (select m.*, case when stockout = 1 then greatest(sales, greatest(baseline, 0e0) * (1e0 + 18e-2 * promo)) else sales end as mean,
                 greatest(coalesce(std28, 25e-2 * abs(baseline)), 5e-1) as spread from m),
    u as (select r.*, case when stockout = 1 then spread + 35e-2 * (mean - sales) else 5e-2 * greatest(sales, 1e0) end as unc from r)
    select series_id, date_idx, sales, demand, stockout, price, promo, category, store, dow, controlled_true_demand, controlled_stockout,
           mean as recovered_demand_mean, unc as recovery_uncertainty, mean + 84e-2 * unc as recovered_q80, mean + 164e-2 * unc as recovered_q95, 1e0 / (1e0 + unc / (mean + 1e0)) as recovery_confidence
    from u"""


RECOVERED = Step(("panel",), _recover)


def _diagnostics(d: Dialect) -> str:
    c = "controlled_stockout = 1"
    avg = lambda x: f"avg(case when {c} then {x} end)"
    return f"""
    with a as (select cast(count(case when {c} then 1 end) as bigint) as n_controlled, {avg('abs(sales - controlled_true_demand)')} as raw_mae,
                      {avg('abs(recovered_demand_mean - controlled_true_demand)')} as recovered_mae, {avg('sales - controlled_true_demand')} as raw_bias,
                      {avg('recovered_demand_mean - controlled_true_demand')} as recovered_bias,
                      {avg('case when controlled_true_demand <= recovered_q80 then 1e0 else 0e0 end')} as q80_upper_coverage,
                      {avg('case when controlled_true_demand <= recovered_q95 then 1e0 else 0e0 end')} as q95_upper_coverage,
                      coalesce(max(case when stockout = 0 then abs(recovered_demand_mean - sales) end), 0e0) as do_no_harm_max from {{panel}})
    select a.*, (raw_mae - recovered_mae) / (raw_mae + 1e-9) as mae_improvement, (abs(raw_bias) - abs(recovered_bias)) / (abs(raw_bias) + 1e-9) as absolute_bias_improvement from a"""


DIAGNOSTICS = Step(("panel",), _diagnostics)


def posterior(n_draws: int = 30, seed: int = 42) -> Step:
    """Normal draws of censored rows, not below what was sold."""

    def sql(d: Dialect) -> str:
        return f"""
        select series_id, date_idx, draw, greatest(recovered_demand_mean + greatest(recovery_uncertainty, 1e-6) * {d.normal(str(seed), '3', 'series_id', 'date_idx', 'draw')}, sales) as latent_demand_draw
        from (select p.*, {d.series(0, n_draws - 1)} as draw from {{panel}} p where stockout = 1) x"""

    return Step(("panel",), sql)


def add_controlled_stockouts(panel: DataFrame, seed: int = 42, rate: float = 0.12) -> DataFrame:
    return controlled_stockouts(seed, rate).run(panel=panel)


def recover_latent_demand(panel: DataFrame) -> DataFrame:
    return RECOVERED.run(panel=panel)


def recovery_diagnostics(panel: DataFrame) -> DataFrame:
    return DIAGNOSTICS.run(panel=panel)


def sample_recovery_posterior(panel: DataFrame, n_draws: int = 30, seed: int = 42) -> DataFrame:
    return posterior(n_draws, seed).run(panel=panel)
