"""Frames for pretrained time-series models: dated context and future, and per-series training inputs.

The model itself is injected: ``predict`` takes a context and a future frame and is run per series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the day of date_idx 0.
EPOCH = "2000-01-01"


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.date_add(F.lit(EPOCH).cast("date"), F.col("date_idx").cast("int")))


def context_frame(panel: DataFrame, origin: int, value: str = "recovered_demand_mean") -> DataFrame:
    """Each series up to ``origin``: item_id, timestamp, target and covariates."""
    return _dated(panel.where(F.col("date_idx") <= origin)).select(F.col("series_id").alias("item_id"), "timestamp", F.col(value).alias("target"), "price", "promo", "dow")


def future_frame(panel: DataFrame, origin: int, horizon: int) -> DataFrame:
    """Known covariates of the ``horizon`` days after ``origin``. Without any, the last price, no
    promotion and the weekday go on; a series with some of its days only is an error."""
    last = panel.where(F.col("date_idx") == origin).select("series_id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "price", "promo", "dow")
    known = panel.where((F.col("date_idx") > origin) & (F.col("date_idx") <= origin + horizon))
    partial = known.groupBy("series_id").count().where(F.col("count") != horizon)
    if not partial.isEmpty():
        raise ValueError("a series has part of its future covariates only")
    k = known.select("series_id", (F.col("date_idx") - origin).alias("step"), F.col("price").alias("k_price"), F.col("promo").alias("k_promo"), F.col("dow").alias("k_dow"))
    rows = last.join(k, ["series_id", "step"], "left").withColumn("date_idx", F.lit(origin) + F.col("step"))
    return _dated(rows).select(
        F.col("series_id").alias("item_id"), "timestamp", F.coalesce("k_price", "price").alias("price"), F.coalesce("k_promo", F.lit(0)).alias("promo"),
        F.coalesce("k_dow", F.pmod(F.col("dow") + F.col("step"), F.lit(7))).alias("dow"),
    )


def training_inputs(panel: DataFrame, cutoff: int, value: str = "recovered_demand_mean") -> DataFrame:
    """One row per series: target and past covariates as float arrays in order of days."""
    ordered = F.array_sort(F.collect_list(F.struct("date_idx", F.col(value).cast("float").alias("y"), F.col("price").cast("float").alias("price"), F.col("promo").cast("float").alias("promo"))))
    rows = panel.where(F.col("date_idx") <= cutoff).groupBy("series_id").agg(ordered.alias("r"))
    return rows.select("series_id", F.col("r.y").alias("target"), F.create_map(F.lit("price"), F.col("r.price"), F.lit("promo"), F.col("r.promo")).alias("past_covariates"))


def fine_tune(panel: DataFrame, cutoff: int, horizon: int, fit: Callable, value: str = "recovered_demand_mean", max_series: int = 10_000, seed: int = 42, **options):
    """What ``fit(inputs, prediction_length, **options)`` returns, for ``inputs`` as a list of dictionaries with target and
    past covariates of each series. A model is fitted in one place: of more than ``max_series`` series those of the smallest
    key hashes are taken, whatever the order of rows."""
    rows = training_inputs(panel, cutoff, value).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "series_id")), "series_id").limit(max_series).collect()
    if not rows:
        raise ValueError("there is nothing to fit")
    return fit([{"target": r.target, "past_covariates": r.past_covariates} for r in rows], prediction_length=horizon, **options)


def forecast_with(panel: DataFrame, origin: int, horizon: int, predict: Callable, model: str, value: str = "recovered_demand_mean") -> DataFrame:
    """Run ``predict(context, future)`` (pandas frames of one series; returns timestamp, q10, q50,
    q90) for each series, side by side. Days beyond the horizon are left out. A series of which a day is missing or
    comes twice, or with a quantile that is no number, fails the query; bounds are repaired to enclose the median."""
    import pandas as pd

    start = pd.Timestamp(EPOCH)

    def one(key, context: pd.DataFrame, future: pd.DataFrame) -> pd.DataFrame:
        out = predict(context.sort_values("timestamp"), future.sort_values("timestamp"))
        lacking = {"timestamp", "q10", "q50", "q90"} - set(out.columns)
        if lacking:
            raise ValueError(f"the forecast of {key[0]} has no columns {sorted(lacking)}")
        out = out.assign(step=(pd.to_datetime(out["timestamp"]) - start).dt.days - origin)
        out = out[out["step"].between(1, horizon)].sort_values("step")
        if out["step"].tolist() != list(range(1, horizon + 1)):
            raise ValueError(f"the forecast of {key[0]} has the days {out['step'].tolist()} of {horizon}")
        if out[["q10", "q50", "q90"]].isna().any().any():
            raise ValueError(f"the forecast of {key[0]} has null quantiles")
        mid = out["q50"].clip(lower=0)
        low, high = out["q10"].clip(lower=0).combine(mid, min), out["q90"].clip(lower=0).combine(mid, max)
        return pd.DataFrame({"series_id": key[0], "date_idx": out["step"] + origin, "horizon": out["step"], "q10": low, "q50": mid, "q90": high, "model": model})

    past, ahead = context_frame(panel, origin, value), future_frame(panel, origin, horizon)
    shape = "series_id string, date_idx int, horizon int, q10 double, q50 double, q90 double, model string"
    return past.groupBy("item_id").cogroup(ahead.groupBy("item_id")).applyInPandas(one, shape)
