"""Baseline quantile forecasts at any number of origins in one plan, and conformal calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dialect import Dialect
from larkspur.plans.steps import Step, checkpointed

from .order_statistics import boundary, cell, order_statistics, pivots

COLUMNS = "series_id, origin, date_idx, horizon, q10, q50, q90, model"


def _history(origins: tuple[int, ...], value: str) -> str:
    """Rows at or before each origin, numbered from the latest (back, from 0)."""
    rows = " union all ".join(f"select {o} as origin" for o in origins)
    return f"""select p.series_id, o.origin, p.date_idx, {value} as v, row_number() over (partition by p.series_id, o.origin order by p.date_idx desc) - 1 as back,
                      row_number() over (partition by p.series_id, o.origin order by p.date_idx) as nr, {value} - lag({value}, 7) over (partition by p.series_id, o.origin order by p.date_idx) as d7
               from {{panel}} p cross join ({rows}) o where p.date_idx <= o.origin"""


def seasonal_step(origins: tuple[int, ...], horizon: int, value: str = "sales") -> Step:
    def sql(d: Dialect) -> str:
        return f"""
        with h as ({_history(origins, value)}),
        s as (select series_id, origin, count(*) as n, {d.quantile('case when back < 28 then v end')} as fallback, {d.quantile('case when back < 28 then abs(d7) end')} as spread from h group by series_id, origin),
        c as (select s.*, case when n >= 8 then spread else greatest(1e0, 25e-2 * fallback) end as raw from s),
        e as (select c.*, case when raw > 0 then raw else greatest(5e-1, 25e-2 * fallback) end as scale from c),
        g as (select e.*, {d.series(1, horizon)} as horizon from e),
        f as (select g.series_id, g.origin, g.origin + g.horizon as date_idx, g.horizon, greatest(coalesce(p.v, fallback), 0e0) as q50, scale
              from g left join (select series_id, origin, date_idx, v from h) p on p.series_id = g.series_id and p.origin = g.origin and p.date_idx = g.origin + g.horizon - 7)
        select series_id, origin, date_idx, horizon, greatest(q50 - 128e-2 * scale, 0e0) as q10, q50, greatest(q50 + 128e-2 * scale, 0e0) as q90, 'seasonal_naive' as model from f"""

    return Step(("panel",), sql)


def tsb_step(origins: tuple[int, ...], horizon: int, value: str = "sales", alpha: float = 0.2, beta: float = 0.2) -> Step:
    """Exponential smoothing of the chance and size of demand. Both recurrences are linear, so
    each is a sum of powers of its decay: ordinary aggregates that combine before the shuffle."""

    def sql(d: Dialect) -> str:
        return f"""
        with h as ({_history(origins, value)}),
        k as (select h.*, sum(case when v > 0 then 1 else 0 end) over (partition by series_id, origin order by date_idx desc rows between unbounded preceding and current row) - 1 as later from h),
        s as (select series_id, origin, count(*) as n, count(case when v > 0 then 1 end) as m, avg(case when nr <= 14 then case when v > 0 then 1e0 else 0e0 end end) as p0,
                     {d.best('v', 'case when v > 0 then 0 else 1 end', 'date_idx')} as first_v,
                     sum(case when v > 0 then {beta}e0 * power({1 - beta}e0, cast(back as double)) else 0e0 end) as p1,
                     sum(case when v > 0 then {alpha}e0 * power({1 - alpha}e0, cast(later as double)) * v else 0e0 end) as s1,
                     stddev_pop(case when back < 28 then v end) as spread from k group by series_id, origin),
        f as (select s.*, (power({1 - beta}e0, cast(n as double)) * p0 + p1) * (case when m > 0 then power({1 - alpha}e0, cast(m as double)) * first_v + s1 else 0e0 end) as q50, coalesce(spread, 0e0) as spread0 from s),
        f1 as (select f.*, greatest(5e-1, case when n > 1 then spread0 else 3e-1 * q50 end) as scale from f),
        g as (select f1.*, {d.series(1, horizon)} as horizon from f1)
        select series_id, origin, origin + horizon as date_idx, horizon, greatest(q50 - 128e-2 * scale, 0e0) as q10, q50, q50 + 128e-2 * scale as q90, 'tsb' as model from g"""

    return Step(("panel",), sql)


UNION = Step(("a", "b"), lambda d: f"select {COLUMNS} from {{a}} union all select {COLUMNS} from {{b}}")

REPAIRED = "greatest(q50, 0e0) as q50, least(greatest(q10, 0e0), greatest(q50, 0e0)) as q10, greatest(greatest(q90, 0e0), greatest(q50, 0e0)) as q90"
REPAIR = Step(("forecast",), lambda d: f"select series_id, origin, date_idx, horizon, model, {REPAIRED} from {{forecast}}")


def adjustment_step(targets: tuple[int, ...], shrinkage: float = 30.0) -> Step:
    """Signed conformal adjustments of each target origin, from the scores of all origins before
    it: the order statistic of rank ceil((n + 1) * 4 / 5) per model and horizon, shrunk towards the
    model's own. A fold counts from the next target on."""

    def sql(d: Dialect) -> str:
        rank = "least(n, (4 * (n + 1) + 4) div 5)" if d.spark else "least(n, (4 * (n + 1) + 4) // 5)"
        rows = " union all ".join(f"select {o} as target_origin" for o in targets)
        return f"""
        with s as (select f.model, f.origin, f.horizon, greatest(q10 - t.demand, t.demand - q90) as score from {{forecast}} f join {{truth}} t on t.series_id = f.series_id and t.date_idx = f.date_idx),
        e as (select target_origin, model, horizon, score from s join ({rows}) o on s.origin < o.target_origin),
        r as (select e.*, row_number() over (partition by target_origin, model, horizon order by score) as i, count(*) over (partition by target_origin, model, horizon) as n from e),
        l as (select target_origin, model, horizon, max(n) as n, max(case when i = {rank} then score end) as local_adjustment from r group by target_origin, model, horizon),
        q as (select e.*, row_number() over (partition by target_origin, model order by score) as i, count(*) over (partition by target_origin, model) as n from e),
        p as (select target_origin, model, max(case when i = {rank} then score end) as pooled_adjustment from q group by target_origin, model)
        select l.target_origin, l.model, l.horizon, n / (n + {shrinkage}e0) * local_adjustment + (1e0 - n / (n + {shrinkage}e0)) * pooled_adjustment as adjustment, local_adjustment, pooled_adjustment,
               n / (n + {shrinkage}e0) as shrinkage_weight, n
        from l join p on l.model = p.model and l.target_origin = p.target_origin"""

    def build(forecast: DataFrame, truth: DataFrame) -> DataFrame:
        return conformal_ranks(forecast, truth, targets, shrinkage)

    return Step(("forecast", "truth"), sql, build)


def conformal_ranks(forecast: DataFrame, truth: DataFrame, targets: tuple[int, ...], shrinkage: float = 30.0, **sizes: int) -> DataFrame:
    """The adjustments from rank histograms. Scores are counted once by model, horizon, origin and cell;
    a target sums the counts of the origins before it, so no score is copied for it but those of
    the cell that holds its rank."""
    scores = conformal_scores(forecast.join(truth.select("series_id", "date_idx", "demand"), ["series_id", "date_idx"]))
    cuts = scores.groupBy("model").agg(pivots("score").alias("cuts")).withColumnRenamed("model", "_model")
    celled = checkpointed(scores.join(cuts, F.col("model").eqNullSafe(F.col("_model"))).select("model", "origin", "horizon", "score", cell("score", "cuts").alias("cell")))
    return adjustments_from(celled, celled.groupBy("model", "horizon", "origin", "cell").agg(F.count(F.lit(1)).alias("n")), targets, shrinkage, **sizes)


def conformal_scores(rows: DataFrame) -> DataFrame:
    """(model, origin, horizon, score): how far ``demand`` lies outside of q10 to q90, negative within."""
    return rows.select("model", "origin", "horizon", F.expr("greatest(q10 - demand, demand - q90)").alias("score"))


def adjustments_from(celled: DataFrame, counts: DataFrame, targets: tuple[int, ...], shrinkage: float = 30.0, **sizes: int) -> DataFrame:
    """Adjustments of ``targets`` from scores in cells that ascend with them, ``celled`` (model, origin, horizon, score,
    cell), and their ``counts`` (model, horizon, origin, cell, n). Only cells that hold a rank are read for scores."""
    target = celled.sparkSession.createDataFrame([(t,) for t in targets], "target_origin int")
    earlier = counts.join(F.broadcast(target), F.col("origin") < F.col("target_origin"))

    def at_rank(keys: list[str], out: str) -> DataFrame:
        by = ", ".join(keys)
        cells = earlier.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
        rank = "least(total, (4 * (total + 1) + 4) div 5)"
        ranked = cells.withColumn("total", F.expr(f"sum(n) over (partition by {by})")).selectExpr("*", f"{rank} as a", f"{rank} as b")
        held = checkpointed(boundary(ranked, keys).withColumn("of_cell", F.col("first_cell")))
        own = [k for k in keys if k != "target_origin"]
        named = held.withColumnsRenamed({k: f"_h_{k}" for k in own})
        same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in own]
        rows = celled.join(named, [*same, F.col("cell") == F.col("of_cell"), F.col("origin") < F.col("target_origin")]).select(*keys, "score")
        return order_statistics(rows, keys, "score", held, **sizes).select(*keys, F.col("at_a").alias(out))

    local = at_rank(["target_origin", "model", "horizon"], "local_adjustment")
    pooled = at_rank(["target_origin", "model"], "pooled_adjustment")
    n = earlier.groupBy("target_origin", "model", "horizon").agg(F.sum("n").alias("n"))
    joined = n.join(local, ["target_origin", "model", "horizon"]).join(pooled, ["target_origin", "model"]).withColumn("shrinkage_weight", F.expr(f"n / (n + {shrinkage}D)"))
    return joined.selectExpr("target_origin", "model", "horizon", "shrinkage_weight * local_adjustment + (1D - shrinkage_weight) * pooled_adjustment as adjustment", "local_adjustment", "pooled_adjustment", "shrinkage_weight", "n")


def applied_step(targets: tuple[int, ...]) -> Step:
    """Forecasts of the target origins, each with the adjustments of its own origin."""

    def sql(d: Dialect) -> str:
        return f"""
        with a as (select f.series_id, f.origin, f.date_idx, f.horizon, f.model, greatest(q10 - coalesce(adjustment, 0e0), 0e0) as q10, q50, greatest(q90 + coalesce(adjustment, 0e0), q50) as q90
                   from {{forecast}} f left join {{adjustment}} a on a.model = f.model and a.horizon = f.horizon and a.target_origin = f.origin where f.origin in ({", ".join(map(str, targets))}))
        select series_id, origin, date_idx, horizon, model, {REPAIRED} from a"""

    return Step(("forecast", "adjustment"), sql)


def seasonal_naive_forecast(panel: DataFrame, origins: tuple[int, ...], horizon: int, value: str = "sales") -> DataFrame:
    return seasonal_step(tuple(origins), horizon, value).run(panel=panel)


def tsb_forecast(panel: DataFrame, origins: tuple[int, ...], horizon: int, value: str = "sales", alpha: float = 0.2, beta: float = 0.2) -> DataFrame:
    return tsb_step(tuple(origins), horizon, value, alpha, beta).run(panel=panel)


def repair_quantiles(forecast: DataFrame) -> DataFrame:
    return REPAIR.run(forecast=forecast)


def fit_conformal_adjustments(forecast: DataFrame, truth: DataFrame, targets: tuple[int, ...]) -> DataFrame:
    return adjustment_step(tuple(targets)).run(forecast=forecast, truth=truth)


def apply_conformal_adjustments(forecast: DataFrame, adjustment: DataFrame, targets: tuple[int, ...]) -> DataFrame:
    return applied_step(tuple(targets)).run(forecast=forecast, adjustment=adjustment)


def _coverage(d: Dialect) -> str:
    bad = lambda x: f"cast(count(case when {x} then 1 end) as bigint)"
    return f"""
    with k as (select distinct series_id, date_idx from {{truth}}), m as (select distinct model from {{forecast}}),
    want as (select model, series_id, date_idx from m cross join k), got as (select distinct model, series_id, date_idx from {{forecast}}),
    c as (select count(*) as row_count, {bad("not coalesce(abs(q10) < cast('infinity' as double) and abs(q50) < cast('infinity' as double) and abs(q90) < cast('infinity' as double), false)")} as null_quantiles, {bad('q10 < 0 or q50 < 0 or q90 < 0')} as negative_forecasts,
                 {bad('q10 > q50 or q50 > q90')} as quantile_crossing, {bad('horizon is null or horizon < 1')} as bad_horizons,
                 {bad('series_id is null or model is null or date_idx is null')} as null_ids from {{forecast}})
    select c.*, (select count(*) from want w where not exists (select 1 from got g where g.model = w.model and g.series_id = w.series_id and g.date_idx = w.date_idx)) as missing_keys,
           (select count(*) from got g where not exists (select 1 from want w where w.model = g.model and w.series_id = g.series_id and w.date_idx = g.date_idx)) as extra_keys,
           (select count(*) from (select model, series_id, origin from {{forecast}} group by model, series_id, origin having max(horizon) <> count(distinct horizon) or count(distinct date_idx - horizon) <> 1) x) as broken_horizons,
           (select count(*) from (select 1 as one from {{forecast}} group by model, series_id, origin, date_idx having count(*) > 1) x) as duplicate_keys
    from c"""


KEY_COVERAGE = Step(("forecast", "truth"), _coverage)


def forecast_contract(forecast: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of counts; a valid forecast has zeros in all but row_count."""
    return KEY_COVERAGE.run(forecast=forecast, truth=truth)


def validate_forecast(forecast: DataFrame, truth: DataFrame) -> None:
    counts = forecast_contract(forecast, truth).first().asDict()
    if not counts["row_count"]:
        raise ValueError("forecast is empty")
    faults = {k: v for k, v in counts.items() if k != "row_count" and v}
    if faults:
        raise ValueError(f"forecast breaks its contract: {faults}")
