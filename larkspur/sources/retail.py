"""Retail archives: wide daily sales, a calendar and weekly prices, as three CSV files in a ZIP."""

from __future__ import annotations

import shutil
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import panel as panels

FILES = ("sales_train_evaluation.csv", "calendar.csv", "sell_prices.csv")


def unpack(archive: str, folder: str) -> dict[str, str]:
    """Copy the three files out of ``archive``; ``folder`` must be one that the readers share."""
    out = {}
    with zipfile.ZipFile(archive) as z:
        for name in FILES:
            member = next((m for m in z.namelist() if m.rsplit("/", 1)[-1] == name), None)
            if member is None:
                raise FileNotFoundError(f"{archive} has no {name}")
            out[name] = str(Path(folder) / name)
            with z.open(member) as source, open(out[name], "wb") as target:
                shutil.copyfileobj(source, target)
    return out


def load_retail(spark: SparkSession, sales: str, calendar: str, prices: str, n_series: int, history_days: int, offset: int = 0) -> DataFrame:
    """The panel of a diverse cohort over the last ``history_days`` days, from three CSV files."""
    wide, cal, price = (spark.read.option("header", True).csv(f) for f in (sales, calendar, prices))
    return panel_of(wide, cal, price, n_series, history_days, offset)


def panel_of(wide: DataFrame, calendar: DataFrame, prices: DataFrame, n_series: int, history_days: int, offset: int = 0) -> DataFrame:
    """Only the last day columns are used; the cohort's keys reduce sales and prices in semi joins
    before anything is unpivoted or joined."""
    days = [c for c in wide.columns if c.startswith("d_")][-history_days:]
    ids = ["id", "item_id", "cat_id", "store_id", "state_id"]
    narrow = wide.select(*ids, *[F.col(d).cast("double").alias(d) for d in days])
    long = narrow.unpivot(ids, days, "d", "sales")
    cal = calendar.select(
        "d", F.col("wm_yr_wk").cast("int").alias("wm_yr_wk"), F.col("wday").cast("int").alias("wday"), "event_name_1",
        *[F.col(f"snap_{s}").cast("int").alias(f"snap_{s}") for s in ("CA", "TX", "WI")],
    )
    first = int(days[0][2:])
    volume = long.select(F.col("id").alias("series_id"), F.col("cat_id").alias("category"), F.col("store_id").alias("store"), (F.substring("d", 3, 9).cast("int") - first).alias("date_idx"), "sales")
    chosen = panels.select_cohort(volume, n_series, offset).select(F.col("series_id").alias("id"))
    rows = long.join(chosen, "id", "left_semi").join(cal, "d", "left")
    price = prices.select("store_id", "item_id", F.col("wm_yr_wk").cast("int").alias("wm_yr_wk"), F.col("sell_price").cast("double").alias("sell_price"))
    rows = rows.join(price.join(rows.select("store_id", "item_id").distinct(), ["store_id", "item_id"], "left_semi"), ["store_id", "item_id", "wm_yr_wk"], "left")
    snap = F.when(F.col("state_id") == "CA", F.col("snap_CA")).when(F.col("state_id") == "TX", F.col("snap_TX")).otherwise(F.col("snap_WI"))
    raw = rows.select(
        F.col("id").alias("series_id"), (F.substring("d", 3, 9).cast("int") - first).alias("date_idx"), "sales", F.col("sales").alias("demand"), F.lit(0).alias("stockout"),
        F.col("sell_price").alias("price"), F.when(F.col("event_name_1").isNotNull() | (snap == 1), 1).otherwise(0).alias("promo"), F.col("cat_id").alias("category"), F.col("store_id").alias("store"),
        F.pmod(F.col("wday") - 1, F.lit(7)).alias("dow"), "item_id", "wm_yr_wk",
    )
    return panels.with_known_prices(raw, [["store", "wm_yr_wk"], ["item_id", "wm_yr_wk"], ["wm_yr_wk"]]).drop("item_id", "wm_yr_wk")


def load_archive(spark: SparkSession, archive: str, n_series: int, history_days: int, offset: int = 0, split_bytes: int | None = None) -> DataFrame:
    """The same from the archive itself: members are read in ranges by many tasks, needed columns only."""
    from .archive import ArchiveSource

    spark.dataSource.register(ArchiveSource)

    def member(name: str, columns: list[str] | None = None) -> DataFrame:
        reader = spark.read.format("csv_archive").option("member", name)
        if split_bytes:
            reader = reader.option("splitBytes", split_bytes)
        if columns:
            reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
        return reader.load(archive)

    days = [c for c in member(FILES[0]).columns if c.startswith("d_")][-history_days:]
    return panel_of(
        member(FILES[0], ["id", "item_id", "cat_id", "store_id", "state_id", *days]),
        member(FILES[1], ["d", "wm_yr_wk", "wday", "event_name_1", "snap_CA", "snap_TX", "snap_WI"]),
        member(FILES[2], ["store_id", "item_id", "wm_yr_wk", "sell_price"]), n_series, history_days, offset,
    )
