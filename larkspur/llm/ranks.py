"""Dense ranks within keys of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked(rows: DataFrame, key: str | None, order: list[str], buckets: int, out: str) -> DataFrame:
    """``rows`` with ``out``: 0-based rank within ``key`` (all rows, if None), dense.

    Rows are dealt into ``buckets`` by a hash of the ``order`` columns; a row's rank is the
    size of the buckets before its own plus its place there. No task sorts a whole key, and
    the counts that are gathered have one row per key and bucket.
    """
    by = [key] if key else []
    dealt = rows.withColumn("_r_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = ", ".join([*by, "_r_bucket"])
    placed = dealt.withColumn("_r_place", F.expr(f"row_number() over (partition by {keys} order by {', '.join(order)}) - 1"))
    counts = dealt.groupBy(*by, "_r_bucket").agg(F.count(F.lit(1)).alias("_r_n"))
    part = f"partition by {key}" if key else ""
    before = counts.select(*by, "_r_bucket", F.expr(f"coalesce(sum(_r_n) over ({part} order by _r_bucket rows between unbounded preceding and 1 preceding), 0)").alias("_r_before"))
    return placed.join(before, [*by, "_r_bucket"]).withColumn(out, F.expr("_r_before + _r_place")).drop("_r_bucket", "_r_place", "_r_before")
