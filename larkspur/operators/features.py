"""Strictly past-only features and the frames that direct forecasters learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larkspur.functions.dialect import Dialect
from larkspur.plans.steps import Step

FEATURES = ["lag_1", "lag_7", "lag_14", "lag_28", *[f"roll_{k}_{w}" for w in (7, 14, 28) for k in ("mean", "std")], "zero_ratio_14", "price_change", "series_age"]


def time_features_step(value: str = "sales") -> Step:
    """All frames share one partitioning and one order, so they are one sort and two windows."""

    def sql(d: Dialect) -> str:
        o = "over (partition by series_id order by date_idx"
        lags = ", ".join(f"coalesce(lag({value}, {k}) {o}), 0e0) as lag_{k}" for k in (1, 7, 14, 28))
        rolls = ", ".join(
            f"coalesce(case when count({value}) {o} rows between {w} preceding and 1 preceding) >= 2 then {f}({value}) {o} rows between {w} preceding and 1 preceding) end, 0e0) as roll_{n}_{w}"
            for w in (7, 14, 28) for n, f in (("mean", "avg"), ("std", "stddev_samp"))
        )
        return f"""
        with s as (select p.*, {lags}, {rolls}, coalesce((price - lag(price) {o})) / nullif(lag(price) {o}), 0), 0e0) as price_change,
                          cast(row_number() {o}) - 1 as double) as series_age, case when lag({value}) {o}) = 0 then 1e0 else 0e0 end as was_zero from {{panel}} p)
        select series_id, date_idx, sales, demand, stockout, price, promo, category, store, dow, recovered_demand_mean, {", ".join(FEATURES[:10])},
               case when series_age >= 1 then avg(was_zero) {o} rows between 13 preceding and current row) else 0e0 end as zero_ratio_14, price_change, series_age
        from s"""

    return Step(("panel",), sql)


def training_step(cutoff: int, horizon: int) -> Step:
    """Each day up to ``cutoff`` with targets and known covariates 1..horizon days on, none beyond it."""

    def sql(d: Dialect) -> str:
        return f"""
        select b.*, h.horizon, f.recovered_demand_mean as target, f.dow as future_dow, f.price as future_price, f.promo as future_promo
        from (select * from {{featured}} where date_idx <= {cutoff}) b cross join (select {d.series(1, horizon)} as horizon) h
             join (select series_id, date_idx, recovered_demand_mean, dow, price, promo from {{featured}} where date_idx <= {cutoff}) f
               on f.series_id = b.series_id and f.date_idx = b.date_idx + h.horizon"""

    return Step(("featured",), sql, lambda featured: multi_horizon(featured.where(f"date_idx <= {cutoff}"), horizon).drop("target_day"))


def multi_horizon(featured: DataFrame, horizon: int) -> DataFrame:
    """Each day with target and known covariates 1..horizon days on, and their day as ``target_day``:
    one sort, in which a window gathers the days ahead; rows are copied last. Nothing is joined."""
    by = f"(partition by series_id order by date_idx rows between 1 following and {horizon} following)"
    ahead = f"collect_list(struct(date_idx as target_day, recovered_demand_mean as target, dow as future_dow, price as future_price, promo as future_promo)) over {by} as ahead"
    columns = [c for c in featured.columns]
    out = featured.selectExpr("*", ahead).selectExpr(*columns, "inline(ahead)").where(f"target_day - date_idx between 1 and {horizon}")
    return out.selectExpr(*columns, "target_day - date_idx as horizon", "target", "future_dow", "future_price", "future_promo", "target_day")


def origin_step(origin: int, horizon: int) -> Step:
    def sql(d: Dialect) -> str:
        own = ", ".join(f"o.{c}" for c in ("sales", "demand", "stockout", "category", "store", "recovered_demand_mean", *FEATURES))
        return f"""
        select o.series_id, o.date_idx + o.horizon as date_idx, o.horizon, {own},
               coalesce(f.dow, (o.dow + o.horizon) % 7) as future_dow, coalesce(f.price, o.price) as future_price, coalesce(f.promo, 0) as future_promo
        from (select x.*, {d.series(1, horizon)} as horizon from {{featured}} x where date_idx = {origin}) o
             left join (select series_id, date_idx, dow, price, promo from {{featured}} where date_idx > {origin} and date_idx <= {origin + horizon}) f
               on f.series_id = o.series_id and f.date_idx = o.date_idx + o.horizon"""

    return Step(("featured",), sql)


def add_time_features(panel: DataFrame, value: str = "sales") -> DataFrame:
    return time_features_step(value).run(panel=panel)


def build_direct_training_frame(featured: DataFrame, cutoff: int, horizon: int, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """With ``max_rows``, the rows of smallest key hash: a sample that does not depend on their order."""
    out = training_step(cutoff, horizon).run(featured=featured)
    if max_rows:
        from pyspark.sql import functions as F

        out = out.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "series_id", "date_idx", "horizon"))).limit(max_rows)
    return out


def build_origin_frame(featured: DataFrame, origin: int, horizon: int) -> DataFrame:
    return origin_step(origin, horizon).run(featured=featured)
