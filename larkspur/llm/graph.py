"""Connected components over edge tables, without a node, an edge or a label on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame, limit: int = 40) -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b): the smallest node that it reaches.

    Alternating large and small stars: every node points its neighbours to the smallest one
    it knows. A round halves the depth about; each is two minima, combined before they are
    shuffled, and two joins that adaptive execution may split where a node is popular. Rounds
    end when the edges no longer change, which two sums tell.
    """
    now = scratch.materialize(edges.where("a != b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges")
    before = None
    for _ in range(limit):
        both = now.unionByName(now.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as c", "least(a, m) as m")
        large = both.where("b > a").join(least, F.expr("a = c")).selectExpr("b as a", "m as b").where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
        small = large.join(down, F.expr("a = c")).selectExpr("if(b = m, a, b) as a", "m as b").where("a != b").distinct()
        now = scratch.materialize(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38, 0))"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    return now.selectExpr("a as node", "b as component").unionByName(now.selectExpr("b as node", "b as component").distinct())
