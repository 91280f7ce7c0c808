"""Exact order statistics of groups of any size, without sorting or gathering a group.

A rank histogram is an ordinary aggregate, combined before the shuffle: rows are counted by cell
between pivots of a mergeable quantile sketch, each pivot being a cell of its own, so that ties
never stay open. Cumulated counts name the cell that holds a wanted rank; only its rows go on. As a
cell between pivots holds about 1 of PIVOTS rows of its group, the number of rounds follows from
the largest group. At the end the few values that are left are counted, and the counts cumulated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.plans.steps import checkpointed

PIVOTS = 64
#: Values of one group that a task cumulates at the end.
LIMIT = 50_000


def pivots(value: str, n: int = PIVOTS) -> Column:
    """Aggregate: up to ``n`` - 1 distinct values that divide a group evenly, within the sketch's error."""
    return F.array_sort(F.array_distinct(F.percentile_approx(value, [k / n for k in range(1, n)], 100 * n)))


def cell(value: str, cuts: str) -> Column:
    """Even numbers between the ``cuts``, odd ones on them; cells ascend with values."""
    return F.expr(f"aggregate({cuts}, 0, (a, p) -> a + if(p < {value}, 2, if(p = {value}, 1, 0)))")


def _same(keys: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(prefix + k))
    return out


def _prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: prefix + k for k in keys})


def boundary(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_cell, last_cell, a, b) from ``counts`` (keys, cell, n, a, b): the cells that hold the ranks ``a``
    to ``b`` of their group, and these ranks within the cells. A group has as many rows as there are cells."""
    by = ", ".join(keys)
    upto = counts.withColumn("upto", F.expr(f"sum(n) over (partition by {by} order by cell rows between unbounded preceding and current row)"))
    held = upto.where("upto - n < b and upto >= a").groupBy(*keys).agg(
        F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"), F.min(F.expr("upto - n")).alias("before"), F.first("a").alias("a"), F.first("b").alias("b")
    )
    return held.select(*keys, "first_cell", "last_cell", F.expr("a - before").alias("a"), F.expr("b - before").alias("b"))


def order_statistics(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame, limit: int = LIMIT, n: int = PIVOTS) -> DataFrame:
    """(keys, at_a, at_b): the values of ranks ``a`` and ``b`` (from 1, a <= b) of each group of
    ``wanted`` (keys, a, b) among the rows of ``rows`` (keys, value) that are not null. Ranks beyond a group give null."""
    live = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    wanted = wanted.select(*keys, "a", "b")
    largest = live.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, math.ceil(math.log(max(largest, 1) / limit, n / 2)))):
        cuts = live.groupBy(*keys).agg(pivots("v", n).alias("cuts"))
        at = live.join(_prefixed(cuts, keys, "_c_"), _same(keys, "_c_")).select(*keys, "v", cell("v", "cuts").alias("cell"))
        at = checkpointed(at)
        counts = at.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"))
        held = boundary(counts.join(_prefixed(wanted, keys, "_w_"), _same(keys, "_w_")).select(*keys, "cell", "n", "a", "b"), keys)
        wanted = checkpointed(held)
        live = at.join(_prefixed(wanted, keys, "_w_"), _same(keys, "_w_")).where("cell between first_cell and last_cell").select(*keys, "v")
        wanted = wanted.select(*keys, "a", "b")
    counts = live.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    by = ", ".join(keys)
    upto = counts.withColumn("upto", F.expr(f"sum(n) over (partition by {by} order by v rows between unbounded preceding and current row)"))
    joined = upto.join(_prefixed(wanted, keys, "_w_"), _same(keys, "_w_"))
    return joined.groupBy(*keys).agg(F.min(F.expr("case when upto >= a then v end")).alias("at_a"), F.min(F.expr("case when upto >= b then v end")).alias("at_b"))


def group_quantile(rows: DataFrame, keys: list[str], value: str, out: str, p: float = 0.5, **sizes: int) -> DataFrame:
    """(keys, ``out``): the exact quantile of each group with linear interpolation; groups of nulls alone are left out."""
    counts = rows.groupBy(*keys).agg(F.count(value).alias("n")).where("n > 0")
    wanted = counts.selectExpr(*keys, f"cast(floor((n - 1) * {p!r}D) as bigint) + 1 as a", f"cast(ceil((n - 1) * {p!r}D) as bigint) + 1 as b", f"(n - 1) * {p!r}D - floor((n - 1) * {p!r}D) as part")
    found = order_statistics(rows, keys, value, wanted, **sizes)
    joined = found.join(_prefixed(wanted.drop("a", "b"), keys, "_q_"), _same(keys, "_q_"))
    return joined.select(*keys, F.expr("at_a * (1 - part) + at_b * part").alias(out))
