"""Ranks and running sums over a whole table in its order: ranges to tasks, counts per range, offsets added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.plans.steps import checkpointed

#: Rows of a range, about.
PER_RANGE = 500_000


def ordered(df: DataFrame, order: list[str | Column], out: str, weight: str | None = None, per_range: int = PER_RANGE) -> DataFrame:
    """``df`` with ``out``: how many rows (or what sum of the whole numbers in ``weight``) stand before
    each row in ``order``, from 0. Rows that ``order`` does not tell apart stay in one range and follow
    in any order, so a unique last column makes ranks unique. Only counts, one for each range, are
    cumulated in one place."""
    kept = checkpointed(df)
    n = max(1, -(-kept.count() // per_range))
    placed = kept.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(placed.withColumn("_range", F.expr("shiftright(_at, 33)")))  # the id's high bits are the range, the low ones the place in it
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    offsets = placed.groupBy("_range").agg(size.alias("_n")).withColumn("_before", F.expr("coalesce(sum(_n) over (order by _range rows between unbounded preceding and 1 preceding), 0)")).select(F.col("_range").alias("_of"), "_before")
    if weight is None:
        inside = placed.withColumn("_inside", F.expr("_at & 8589934591L"))
    else:
        inside = placed.withColumn("_inside", F.expr(f"coalesce(sum({weight}) over (partition by _range order by _at rows between unbounded preceding and 1 preceding), 0)"))
    return inside.join(F.broadcast(offsets), F.col("_range") == F.col("_of")).withColumn(out, F.expr("cast(_before + _inside as bigint)")).drop("_at", "_range", "_of", "_before", "_inside")


def dictionary(df: DataFrame, column: str, per_range: int = PER_RANGE) -> DataFrame:
    """(``column``, code): 1 + the place of each distinct value in ascending order; null has no code."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    return ordered(values, [column], "_place", per_range=per_range).select(column, F.expr("_place + 1").alias("code"))


def encode(df: DataFrame, column: str, codes: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: the code of ``column``, 0 for values that ``codes`` does not have."""
    named = codes.select(F.col(column).alias("_d_value"), F.col("code").alias("_d_code"))
    return df.join(named, F.col(column) == F.col("_d_value"), "left").withColumn(out, F.coalesce("_d_code", F.lit(0))).drop("_d_value", "_d_code")
