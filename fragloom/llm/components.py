"""Groups of everything that is linked directly or over others, by seed-tree pruning.

Each round every vertex finds the minimum of its neighbourhood and tells it to all its neighbours. A vertex that is nobody's
minimum drops out: it hangs itself below the least minimum it heard of, in a forest, and links the minima it heard of to each
other, so that the rest stays as connected as before. What is left shrinks every round, until only seeds remain, one for each
group and its least vertex. Then the seeds flow down the forest, round by round in reverse.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragloom.operators.skew import attach
from fragloom.session import Scratch


def links_by_key(df: DataFrame, vertex: str, keys: Sequence[Column], scratch: Scratch) -> DataFrame:
    """(u, v): rows that share the value of a key, each linked to the least vertex that has it; never all pairs of a key.

    A key column is an expression that is null where it links nothing. Rows without a vertex are ignored. One value may be
    in any part of the rows.
    """
    pairs = df.where(F.col(vertex).isNotNull()).select(F.col(vertex).alias("u"), F.explode(F.array_compact(F.array(*keys))).alias("key"))
    pairs, seen = scratch.measured(pairs.distinct(), F.count(F.lit(1)).alias("n"))
    least, hot = scratch.measured(pairs.groupBy("key").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), F.max("rows").alias("most"))
    return attach(pairs, least, "key", "rows", max(1, seen["n"]), hot["most"] or 0).where("u <> v").select("u", "v")


def _prune(edges: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, int, DataFrame]:
    """One round over n edges, in both directions: the edges among what is left and their number, (child, parent) of what dropped out."""
    most = F.max("rows").alias("most")
    least, seen = scratch.measured(edges.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("rows")).select("u", F.least("u", "v").alias("m"), "rows"), most)
    heard = attach(edges, least, "u", "rows", n, seen["most"]).select(F.col("v").alias("u"), "m").unionByName(least.select("u", "m")).distinct()
    heard = scratch.table(heard)
    best, seen = scratch.measured(heard.groupBy("u").agg(F.min("m").alias("seed"), F.max(F.col("m") == F.col("u")).alias("stays"), F.count(F.lit(1)).alias("rows")), most)
    apart = attach(heard, best.where("rows > 1").drop("stays"), "u", "rows", n * 2, seen["most"]).where("m <> seed").select("seed", "m")
    both = apart.select(F.inline(F.array(F.struct(F.col("seed").alias("u"), F.col("m").alias("v")), F.struct(F.col("m").alias("u"), F.col("seed").alias("v")))))
    left, seen = scratch.measured(both.distinct(), F.count(F.lit(1)).alias("n"))
    scratch.drop(least, heard)
    return left, seen["n"], best.where("NOT stays").select(F.col("u").alias("child"), F.col("seed").alias("parent"))


def connected_groups(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(vertex, group_id): for every vertex of ``links`` (u, v) the least vertex it is connected with.

    Links have no direction. Loops, repeated links and links with a null end are allowed and link nothing new; a vertex that
    has only loops does not occur in the result. No link gives no row. In every round at least the greatest vertex of each
    group drops out, so the rounds end; they grow with the logarithm of the vertices.
    """
    both = links.where("u <> v").select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    edges, seen = scratch.measured(both.distinct(), F.count(F.lit(1)).alias("n"))
    n = seen["n"]
    dropped: list[DataFrame] = []
    while n:
        before = edges
        edges, n, fallen = _prune(edges, n, scratch)
        scratch.drop(before)
        dropped.append(fallen)
    groups = edges.select(F.col("u").alias("vertex"), F.col("u").alias("group_id"))
    for fallen in reversed(dropped):
        # a parent that has no group yet is a seed
        parents = fallen.groupBy("parent").agg(F.count(F.lit(1)).alias("rows"))
        known = parents.join(groups.withColumnRenamed("vertex", "parent"), "parent", "left").select("parent", F.coalesce("group_id", "parent").alias("group_id"), "rows", F.col("group_id").isNull().alias("seed"))
        known, seen = scratch.measured(known, F.max("rows").alias("most"), F.sum("rows").alias("n"))
        below = attach(fallen, known.drop("seed"), "parent", "rows", max(1, seen["n"] or 0), seen["most"] or 0).select(F.col("child").alias("vertex"), "group_id")
        seeds = known.where("seed").select(F.col("parent").alias("vertex"), F.col("parent").alias("group_id"))
        before, groups = groups, scratch.table(groups.unionByName(below).unionByName(seeds))
        scratch.drop(before)
    return groups


def group_rows(df: DataFrame, vertex: str, keys: Sequence[Column], scratch: Scratch) -> DataFrame:
    """(vertex, group_id) for every distinct vertex of ``df``: its group's least vertex, or itself where it has no link."""
    groups = connected_groups(links_by_key(df, vertex, keys, scratch), scratch)
    own = df.where(F.col(vertex).isNotNull()).select(vertex).distinct()
    return own.join(groups.withColumnRenamed("vertex", vertex), vertex, "left").select(vertex, F.coalesce("group_id", vertex).alias("group_id"))
