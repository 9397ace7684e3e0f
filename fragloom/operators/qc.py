"""Summaries of datasets: length distributions, outliers, insert sizes, depth and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_distribution(fragments: DataFrame, by: Sequence[str] = ("dataset",), value: str = "len", step: int = 5) -> DataFrame:
    """(by, n, mean, std, q): percentiles 0, ``step``, ... 100 by linear interpolation, mean and population deviation."""
    points = F.array(*[F.lit(p / 100) for p in range(0, 101, step)])
    return fragments.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, points).alias("q"))


def resampled(fragments: DataFrame, n: int = 10_000, by: Sequence[str] = ("dataset",), value: str = "len", seed: int = 0) -> DataFrame:
    """(by, draw, value): ``n`` draws with replacement from each group's values, the same in every run.

    Draws fall on places in the sorted values, found from the counts of the distinct values; no value is sorted more than once.
    """
    counts = fragments.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    totals = upto.groupBy(*by).agg(F.sum("c").alias("total"))
    draws = totals.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = F.pmod(F.xxhash64(*by, "draw", F.lit(seed)), F.col("total")).alias("place")
    # values and draws side by side, the greatest place first: a draw takes the last value whose running count is beyond its place
    drawn = draws.select(*by, "draw", place.alias("place"), F.lit(None).cast(dict(fragments.dtypes)[value]).alias(value))
    both = upto.select(*by, F.lit(None).cast("int").alias("draw"), F.col("upto").alias("place"), value).unionByName(drawn)
    before = Window.partitionBy(*by).orderBy(F.desc("place"), F.col("draw").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.coalesce(value, F.last(value, ignorenulls=True).over(before))).where("draw IS NOT NULL").select(*by, "draw", value)


def n50(fragments: DataFrame, by: Sequence[str] = ("dataset",), value: str = "len", shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by, n25, n50, n75): the value at which the running sum, smallest first, reaches a share of all. Runs over the distinct values."""
    counts = fragments.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    mass = F.col(value) * F.col("c")
    running = counts.withColumns({"upto": F.sum(mass).over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(mass).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return running.groupBy(*by).agg(*[F.min(F.when(F.col("upto") >= F.col("total") * s, F.col(value))).alias(f"n{int(s * 100)}") for s in shares])


def trim_outliers(values: DataFrame, by: Sequence[str], value: str, limit: float = 10.0) -> DataFrame:
    """Rows whose value lies less than ``limit`` median absolute deviations above the median; all where that deviation is 0."""
    med = values.groupBy(*by).agg(F.median(value).alias("_med"))
    near = values.join(med, list(by))
    mad = near.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    both = near.join(mad, list(by))
    return both.where((F.col("_mad") == 0) | ((F.col(value) - F.col("_med")) < F.col("_mad") * limit)).drop("_med", "_mad")


def size_at_share(counts: DataFrame, by: Sequence[str], size: str = "size", n: str = "n", share: float = 0.9) -> DataFrame:
    """(by, size): the first size at which the counts, smallest first, reach ``share`` of all."""
    w = Window.partitionBy(*by).orderBy(size)
    upto, total = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.withColumns({"_upto": upto, "_total": total}).where(F.col("_upto") >= F.col("_total") * share).groupBy(*by).agg(F.min(size).alias(size))


def modal_orientation(reads: DataFrame, by: Sequence[str], reverse: Column, mate_reverse: Column, right_of_mate: Column) -> DataFrame:
    """(by, orientation, n): the most frequent strand pair of read and mate, seen from the left one; equals by name."""
    strand = lambda c: F.when(c, "-").otherwise("+")
    pair = F.when(right_of_mate, F.concat(strand(mate_reverse), strand(reverse))).otherwise(F.concat(strand(reverse), strand(mate_reverse)))
    counts = reads.withColumn("orientation", pair).groupBy(*by, "orientation").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min_by("orientation", F.struct((-F.col("n")).alias("n"), "orientation")).alias("orientation"), F.max("n").alias("n"))


def physical_depth(fragments: DataFrame, chroms: DataFrame, skip: int = 1_000_000, share: float = 0.2, group: str = "dataset") -> DataFrame:
    """(group, depth, min_support): median number of fragments over every ``skip`` positions, loci without any included, and a share of it."""
    first, last = F.expr(f"(start_pos + {skip} - 1) div {skip}"), F.expr(f"(end_pos - 1) div {skip}")
    spans = fragments.where("end_pos > start_pos").select(group, "chrom", first.alias("a"), last.alias("b")).where("a <= b")
    hits = spans.withColumn("locus", F.explode(F.sequence("a", "b"))).groupBy(group, "chrom", "locus").agg(F.count(F.lit(1)).alias("n"))
    # loci without a fragment are not made but counted: they are the zeros below the median
    loci = chroms.agg(F.sum(F.expr(f"(length - 1) div {skip} + 1")).alias("loci"))
    known = hits.join(chroms.select("chrom", F.expr(f"(length - 1) div {skip}").alias("last")), "chrom").where("locus <= last")
    depths = known.groupBy(group, "n").agg(F.count(F.lit(1)).alias("c"))
    zeros = depths.groupBy(group).agg(F.sum("c").alias("c")).join(loci).select(group, F.lit(0).cast("bigint").alias("n"), (F.col("loci") - F.col("c")).alias("c"))
    depth = depths.unionByName(zeros.where("c > 0")).groupBy(group).agg(F.percentile("n", F.lit(0.5), F.col("c")).alias("depth"))
    return depth.withColumn("min_support", F.col("depth") * share)


def coverage_track(reads: DataFrame, by: Sequence[str], window: int = 1_000, around: int = 2) -> DataFrame:
    """(by, w, n, smooth): reads by window, and the median of ``2 * around + 1`` windows in a row, null at the edges of what is covered."""
    counts = reads.groupBy(*by, F.expr(f"pos div {window}").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    near = counts.select(*by, F.explode(F.sequence(F.col("w") - around, F.col("w") + around)).alias("w"), "n")
    smooth = near.groupBy(*by, "w").agg(F.percentile("n", F.lit(0.5)).alias("smooth"), F.count(F.lit(1)).alias("_k"))
    return counts.join(smooth, [*by, "w"]).select(*by, "w", "n", F.when(F.col("_k") == 2 * around + 1, F.col("smooth")).alias("smooth"))


def report(distribution: DataFrame, by: str = "dataset") -> DataFrame:
    """(by, line): one formatted line of quantiles for each dataset."""
    show = lambda i: F.format_number(F.element_at("q", i), 0)
    return distribution.select(by, F.concat_ws(" ", F.format_number("n", 0), F.lit("fragments; 25/50/75 %:"), show(6), show(11), show(16), F.lit("; mean"), F.format_number("mean", 1)).alias("line"))
