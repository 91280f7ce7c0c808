"""Two statements of one feature set held against each other, and what may follow from that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dialect import Dialect
from larkspur.plans.steps import Step

from .features import FEATURES

KEYS = ["series_id", "date_idx"]


def features_by_arrays(panel: DataFrame, value: str = "sales") -> DataFrame:
    """The past-only features from the array of each day's 28 days before it, by array functions alone."""
    o = "(partition by series_id order by date_idx rows between {} and 1 preceding)"
    base = panel.selectExpr(
        *KEYS, "price", f"collect_list(cast({value} as double)) over {o.format('28 preceding')} as past", f"collect_list(price) over {o.format('1 preceding')} as paid",
        f"cast(count(*) over {o.format('unbounded preceding')} as double) as series_age",
    )
    tail = lambda w: f"slice(past, greatest(size(past) - {w}, 0) + 1, {w})"
    total = lambda a: f"aggregate({a}, 0D, (s, x) -> s + x)"
    out = base
    for w in (7, 14, 28):
        out = out.withColumn(f"_t{w}", F.expr(tail(w))).withColumn(f"_n{w}", F.expr(f"size(_t{w})")).withColumn(f"_m{w}", F.expr(f"{total(f'_t{w}')} / nullif(_n{w}, 0)"))
    columns = [f"coalesce(try_element_at(past, -{k}), 0D) as lag_{k}" for k in (1, 7, 14, 28)]
    for w in (7, 14, 28):
        columns.append(f"if(_n{w} >= 2, _m{w}, 0D) as roll_mean_{w}")
        columns.append(f"if(_n{w} >= 2, sqrt(aggregate(_t{w}, 0D, (s, x) -> s + (x - _m{w}) * (x - _m{w})) / (_n{w} - 1)), 0D) as roll_std_{w}")
    columns.append("if(series_age >= 1, size(filter(_t14, x -> x = 0)) / least(series_age + 1, 14D), 0D) as zero_ratio_14")
    columns.append("coalesce((price - try_element_at(paid, 1)) / nullif(try_element_at(paid, 1), 0D), 0D) as price_change")
    return out.selectExpr(*KEYS, *columns, "series_age")


def _by_lists(d: Dialect) -> str:
    """The same for the oracle."""
    o = "over (partition by series_id order by date_idx rows between {} and 1 preceding)"
    lags = ", ".join(f"coalesce(past[-{k}], 0) as lag_{k}" for k in (1, 7, 14, 28))
    tail = lambda w: f"list_slice(past, greatest(len(past) - {w}, 0) + 1, len(past))"
    rolls = ", ".join(f"case when len({tail(w)}) >= 2 then list_avg({tail(w)}) else 0 end as roll_mean_{w}, case when len({tail(w)}) >= 2 then list_stddev_samp({tail(w)}) else 0 end as roll_std_{w}" for w in (7, 14, 28))
    return f"""
    with a as (select series_id, date_idx, price, coalesce(list(sales) {o.format('28 preceding')}, []) as past, coalesce(list(price) {o.format('1 preceding')}, []) as paid, cast(count(*) {o.format('unbounded preceding')} as double) as series_age from {{panel}})
    select series_id, date_idx, {lags}, {rolls}, case when series_age >= 1 then len(list_filter({tail(14)}, lambda x: x = 0)) / least(series_age + 1, 14) else 0 end as zero_ratio_14,
           coalesce((price - paid[1]) / nullif(paid[1], 0), 0) as price_change, series_age from a"""


BY_ARRAYS = Step(("panel",), _by_lists, features_by_arrays)


def parity_step(columns: list[str], tolerance: float = 1e-9) -> Step:
    """A row for each column: rows compared, keys that one side lacks, the greatest difference (relative where
    values exceed 1), and whether both sides agree. Nulls agree with nulls alone; one join, one pass."""

    def sql(d: Dialect) -> str:
        apart = lambda c: f"case when (l.{c} is null) <> (r.{c} is null) then cast('infinity' as double) else coalesce(abs(l.{c} - r.{c}) / greatest(1e0, abs(l.{c})), 0e0) end"
        sums = ", ".join(f"max(case when l.series_id is not null and r.series_id is not null then {apart(c)} else 0e0 end) as d_{c}" for c in columns)
        rows = " union all ".join(f"select '{c}' as column_name, n, left_only, right_only, d_{c} as max_difference from s" for c in columns)
        return f"""
        with s as (select count(*) as n, sum(case when r.series_id is null then 1 else 0 end) as left_only, sum(case when l.series_id is null then 1 else 0 end) as right_only, {sums}
                   from {{left_side}} l full outer join {{right_side}} r on l.series_id = r.series_id and l.date_idx = r.date_idx)
        select column_name, n, left_only, right_only, max_difference, n > 0 and left_only = 0 and right_only = 0 and max_difference <= {tolerance!r} as agrees from ({rows}) u"""

    return Step(("left_side", "right_side"), sql)


PARITY = parity_step(FEATURES)


def feature_parity(left: DataFrame, right: DataFrame, columns: list[str] = FEATURES, tolerance: float = 1e-9) -> DataFrame:
    return parity_step(columns, tolerance).run(left_side=left, right_side=right)


def publish_features(panel: DataFrame, root: str, tolerance: float = 1e-9, features: DataFrame | None = None) -> str:
    """Publish the features of ``panel`` as a run, if both statements agree; the run's name."""
    from larkspur.sources.runs import publish_run

    from .features import add_time_features

    first = features if features is not None else add_time_features(panel)
    held = feature_parity(first, features_by_arrays(panel), tolerance=tolerance)
    return publish_run(panel.sparkSession, root, {"features": first, "parity": held}, {"tolerance": tolerance}, allowed=held)
