"""Joins on intervals as equi joins on bins, so that Spark can shuffle them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str], bin_size: int) -> DataFrame:
    """Inner join of rows with equal ``on`` whose closed ranges share a position.

    Both sides go into every bin they touch; a pair is taken in the first bin the two have in common, so it comes out once. A
    range that is null or runs backwards joins nothing. Columns other than ``on`` must differ in name. A hot value of ``on``
    is spread over its bins; ``bin_size`` should be near the usual length of the longer ranges.
    """

    def binned(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
        first, last = F.floor(F.col(low) / bin_size), F.floor(F.col(high) / bin_size)
        rows = df.where(F.col(low) <= F.col(high)).withColumn(f"_{name}", first)
        return rows.withColumn("_bin", F.explode(F.sequence(first, last)))

    a, b = binned(left, *left_range, "l"), binned(right, *right_range, "r")
    meet = (F.col(left_range[0]) <= F.col(right_range[1])) & (F.col(right_range[0]) <= F.col(left_range[1]))
    return a.join(b, [*on, "_bin"]).where(meet & (F.col("_bin") == F.greatest("_l", "_r"))).drop("_bin", "_l", "_r")


def nearest_join(points: DataFrame, intervals: DataFrame, on: Sequence[str], key: Sequence[str], pos: str, start: str, end: str, within: int, bin_size: int) -> DataFrame:
    """For every point the intervals nearest to it, ties kept, at a distance below ``within``, as ``distance``.

    ``key`` identifies a point. A position inside a half-open interval is at distance 0; a point with no interval near has no row.
    """
    reach = points.withColumns({"_low": F.col(pos) - within, "_high": F.col(pos) + within})
    spans = intervals.withColumn("_last", F.col(end) - 1)
    pairs = overlap_join(reach, spans, on, ("_low", "_high"), (start, "_last"), bin_size)
    apart = F.when(F.col(pos) < F.col(start), F.col(start) - F.col(pos)).when(F.col(pos) >= F.col(end), F.col(pos) - F.col(end) + 1).otherwise(F.lit(0))
    pairs = pairs.withColumn("distance", apart).where(F.col("distance") < within)
    near = F.rank().over(Window.partitionBy(*key).orderBy("distance"))
    return pairs.withColumn("_near", near).where("_near = 1").drop("_near", "_low", "_high", "_last")
