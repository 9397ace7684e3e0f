"""Connected components of an edge table, for the clusters of events: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.operators.skew import attach
from fragloom.session import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): the least node it is connected with. Loops keep their node; null ends are ignored.

    Every round that changes anything brings some node below a lesser one, so the rounds end; they grow with the logarithm of
    the nodes. A round writes three tables and drops those of the round before.
    """
    count, most = F.count(F.lit(1)).alias("n"), F.max("rows").alias("most")
    nodes = scratch.table(_both(edges.where("u IS NOT NULL AND v IS NOT NULL")).select(F.col("u").alias("node")).distinct())
    now, seen = scratch.measured(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), count)
    n, state = seen["n"], None
    while True:
        # large star: everything above a node moves to the least neighbour of that node
        both = _both(now)
        least, seen = scratch.measured(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("rows")), most)
        moved = attach(both, least, "u", "rows", max(2 * n, 1), seen["most"] or 0).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(moved.where("u <> v").distinct())
        # small star: a node's lower neighbours, and itself, move to the least of them
        low, seen = scratch.measured(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows")), most)
        moved = attach(large, low, "u", "rows", max(2 * n, 1), seen["most"] or 0).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before = now
        now, seen = scratch.measured(moved.where("u <> v").distinct(), count, F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        scratch.drop(least, large, low, before)
        n, after = seen["n"], (seen["n"], seen["sum"])
        if after == state:
            return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        state = after
