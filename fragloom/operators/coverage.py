"""Continuous coverage of intervals per entity, and the gaps in it, in two levels.

Positions are cut into shards of ``2**shard_bits``. An interval becomes at most three pieces, however long it is: its part
in the first shard, its part in the last one, and one middle piece of whole shards. Level 1 merges the pieces of one
(entity, shard), of which there are at most as many as a shard has positions once equal starts are folded. Level 2 sees per
entity only what touches a shard's edge, the middle pieces folded by start, and one summary per shard: at most three rows
per shard. So one entity may hold any part of all rows and is still spread over tasks. Intervals are half-open; those that
overlap or touch are one stretch. Rows with a missing coordinate or ``end <= start`` cover nothing. Null entity values are
entities. Repeated rows change nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragloom.functions.conventions import usable
from fragloom.session import Scratch

SHARD_BITS = 20


def _named(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Entity columns as k0, k1, ..., so that none can clash with the columns made here."""
    return df.where(usable(start, end)).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))


def _pieces(named: DataFrame, keys: list[str], bits: int) -> tuple[DataFrame, DataFrame]:
    """(local pieces, middle pieces), both as keys, shard, s, e with one row per start; written once, as several branches read them."""
    cut = named.withColumns({"s0": F.shiftright("s", bits), "s1": F.shiftright(F.col("e") - 1, bits)})
    edge, last = F.shiftleft(F.col("s0") + 1, bits), F.shiftleft("s1", bits)
    piece = lambda shard, s, e, middle: F.struct(shard.alias("shard"), s.alias("s"), e.alias("e"), F.lit(middle).alias("middle"))
    head, tail = piece(F.col("s0"), F.col("s"), edge, False), piece(F.col("s1"), last, F.col("e"), False)
    parts = (
        F.when(F.col("s0") == F.col("s1"), F.array(piece(F.col("s0"), F.col("s"), F.col("e"), False)))
        .when(F.col("s1") - F.col("s0") == 1, F.array(head, tail))
        .otherwise(F.array(head, piece(F.col("s0") + 1, edge, last, True), tail))
    )
    folded = cut.select(*keys, F.inline(parts)).groupBy(*keys, "shard", "s", "middle").agg(F.max("e").alias("e"))
    folded = Scratch(named.sparkSession, "pieces").table(folded)
    return folded.where("NOT middle").drop("middle"), folded.where("middle").drop("middle")


def _islands(df: DataFrame, part: list[str]) -> DataFrame:
    """Merges overlapping or touching rows within ``part``."""
    w = Window.partitionBy(*part).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)
    return (
        df.withColumn("_new", starts)
        .withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*part, "_island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("_island")
    )


def _covered_shards(shards: DataFrame, middle: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Of ``shards`` (keys, shard) those that lie wholly under a middle piece; the window sees one row per shard and per middle piece."""
    rows = shards.select(*keys, "shard", F.lit(1).alias("own"), F.lit(None).cast("bigint").alias("e")).unionByName(middle.select(*keys, "shard", F.lit(0).alias("own"), "e"))
    reach = F.max("e").over(Window.partitionBy(*keys).orderBy("shard", "own").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("reach", reach).where((F.col("own") == 1) & (F.col("reach") > F.shiftleft("shard", bits))).select(*keys, "shard")


def _without(df: DataFrame, drop: DataFrame, keys: list[str]) -> DataFrame:
    same = reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    return df.alias("a").join(drop.alias("b"), same & (F.col("a.shard") == F.col("b.shard")), "left_anti")


def merge_intervals(df: DataFrame, by: Sequence[str], start: str = "start_pos", end: str = "end_pos", shard_bits: int = SHARD_BITS) -> DataFrame:
    """(by, stretch_start, stretch_end): the continuous covered stretches of each entity."""
    keys = [f"k{i}" for i in range(len(by))]
    local, middle = _pieces(_named(df, by, start, end), keys, shard_bits)
    merged = _islands(local, [*keys, "shard"])
    at_edge = (F.col("s") == F.shiftleft("shard", shard_bits)) | (F.col("e") == F.shiftleft(F.col("shard") + 1, shard_bits))
    inside = _without(merged.where(~at_edge), _covered_shards(merged.select(*keys, "shard").distinct(), middle, keys, shard_bits), keys)
    stitched = _islands(merged.where(at_edge).drop("shard").unionByName(middle.drop("shard")), keys)
    both = inside.select(*keys, "s", "e").unionByName(stitched.select(*keys, "s", "e"))
    return both.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.col("s").alias("stretch_start"), F.col("e").alias("stretch_end"))


def coverage_gaps(df: DataFrame, by: Sequence[str], start: str = "start_pos", end: str = "end_pos", shard_bits: int = SHARD_BITS) -> DataFrame:
    """(by, gap_start, gap_end): each gap between two successive stretches of an entity."""
    keys = [f"k{i}" for i in range(len(by))]
    local, middle = _pieces(_named(df, by, start, end), keys, shard_bits)
    # level 1: the holes within a shard, and in its last row from where to where its pieces reach
    w = Window.partitionBy(*keys, "shard").orderBy("s")
    seen = local.withColumns(
        {
            "reach": F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "first": F.first("s").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "last": F.max("e").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "following": F.lead("s").over(w),
        }
    )
    ends = seen.where("following IS NULL").select(*keys, "shard", F.col("first").alias("s"), F.col("last").alias("e"))
    holes = seen.where(F.col("s") > F.col("reach")).select(*keys, "shard", F.col("reach").alias("gap_start"), F.col("s").alias("gap_end"))
    holes = _without(holes, _covered_shards(ends, middle, keys, shard_bits), keys)
    # level 2: from one shard's reach to the next one's first piece
    over = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    spans = ends.drop("shard").unionByName(middle.drop("shard")).withColumn("reach", F.max("e").over(over))
    between = spans.where(F.col("s") > F.col("reach")).select(*keys, F.col("reach").alias("gap_start"), F.col("s").alias("gap_end"))
    both = holes.select(*keys, "gap_start", "gap_end").unionByName(between)
    return both.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "gap_start", "gap_end")
