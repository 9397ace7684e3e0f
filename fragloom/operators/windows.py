"""Genomic windows as sets of barcodes, and pairs of windows that share more of them than chance allows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.functions.stats import binom_sf
from fragloom.operators.components import components
from fragloom.session import Scratch

WINDOW = 10_000


def chunk_steps(chroms: DataFrame, size: int) -> DataFrame:
    """(chrom, length, step): how far apart the chunks of ``split_genome`` begin."""
    return chroms.where("length > 0").select("chrom", "length", F.ceil(F.col("length") / F.ceil(F.col("length") / size)).alias("step"))


def split_genome(chroms: DataFrame, size: int) -> DataFrame:
    """(chrom, start, end): near-equal chunks of at most ``size``."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.col("step")))
    return chunk_steps(chroms, size).withColumn("start", starts).select("chrom", "start", F.least(F.col("start") + F.col("step"), F.col("length")).alias("end"))


def search_regions(chroms: DataFrame, window: int, skip: int, skip_at_ends: int) -> DataFrame:
    """(chrom, start, end): windows every ``skip``, away from the ends."""
    last = F.col("length") - skip_at_ends - window
    return chroms.where(last >= skip_at_ends).select("chrom", F.explode(F.sequence(F.lit(skip_at_ends).cast("bigint"), last, F.lit(skip).cast("bigint"))).alias("start")).withColumn("end", F.col("start") + window)


def window_barcodes(fragments: DataFrame, chroms: DataFrame, by: Sequence[str] = ("dataset", "chrom"), window: int = WINDOW) -> DataFrame:
    """(by, w, bc): the barcodes of each window, that is of the fragments that cross one of its edges.

    A fragment crosses the multiples of ``window`` strictly inside it; each belongs to the window before and after it. One
    wholly inside a window does not count. ``by`` must hold ``chrom``.
    """
    first, last = F.expr(f"start_pos div {window} + 1"), F.expr(f"(end_pos - 1) div {window}")
    rows = fragments.where("bc IS NOT NULL AND end_pos > start_pos").select(*by, "bc", first.alias("first"), last.alias("last")).where("last >= first")
    edges = rows.withColumn("w", F.explode(F.sequence(F.col("first") - 1, "last"))).select(*by, "w", "bc")
    sizes = chroms.select("chrom", F.ceil(F.col("length") / window).alias("n"))
    return edges.join(sizes, "chrom").where("w >= 0 AND w < n").select(*by, "w", "bc").distinct()


def window_overlaps(windows: DataFrame, chroms: DataFrame, scratch: Scratch, group: str = "dataset", min_shared: int = 26) -> DataFrame:
    """(group, chromx, wx, chromy, wy, shared, nx, ny): pairs of windows with at least ``min_shared`` barcodes in common.

    Windows that share that many must share one that is not among the ``min_shared - 1`` most frequent barcodes of either, so
    pairs are only made over the others, rarest first. Barcodes that are everywhere make no pairs, and none is lost. What
    the pairs share is then counted exactly. The x side is the later chromosome, or the earlier window of one chromosome.
    """
    windows = scratch.table(windows.select(group, "chrom", "w", "bc"))
    # barcodes go by numbers from here on
    freq = scratch.table(windows.groupBy(group, "bc").agg(F.count(F.lit(1)).alias("f")).withColumn("id", F.monotonically_increasing_id()))
    ordered = windows.join(freq, [group, "bc"]).groupBy(group, "chrom", "w").agg(F.array_sort(F.collect_list(F.struct("f", "id"))).alias("own"))
    ordered = ordered.where(F.size("own") >= min_shared).join(chroms.select("chrom", "idx"), "chrom")
    sets = scratch.table(ordered.select(group, "chrom", "idx", "w", F.size("own").cast("bigint").alias("n"), F.col("own.id").alias("bcs")))
    rare = sets.select(group, "chrom", "idx", "w", F.explode(F.slice("bcs", F.lit(1), (F.col("n") - min_shared + 1).cast("int"))).alias("bc"))
    x, y = rare.alias("x"), rare.alias("y")
    before = (F.col("x.idx") > F.col("y.idx")) | ((F.col("x.idx") == F.col("y.idx")) & (F.col("x.w") < F.col("y.w")))
    pairs = x.join(y, (F.col(f"x.{group}") == F.col(f"y.{group}")) & (F.col("x.bc") == F.col("y.bc")) & before)
    pairs = pairs.select(F.col(f"x.{group}").alias(group), F.col("x.chrom").alias("chromx"), F.col("x.w").alias("wx"), F.col("y.chrom").alias("chromy"), F.col("y.w").alias("wy")).distinct()
    side = lambda s: sets.select(group, F.col("chrom").alias(f"chrom{s}"), F.col("w").alias(f"w{s}"), F.col("n").alias(f"n{s}"), F.col("bcs").alias(f"bcs{s}"))
    both = pairs.join(side("x"), [group, "chromx", "wx"]).join(side("y"), [group, "chromy", "wy"])
    counted = both.select(group, "chromx", "wx", "chromy", "wy", F.size(F.array_intersect("bcsx", "bcsy")).cast("bigint").alias("shared"), "nx", "ny")
    return counted.where(F.col("shared") >= min_shared)


def overlap_p(overlaps: DataFrame, windows: DataFrame, group: str = "dataset", floor: float = 0.001) -> DataFrame:
    """``overlaps`` with ``p``: the chance that more than ``shared`` of nx barcodes are among the ny of all; above ``floor`` it is 1."""
    n = windows.groupBy(group).agg(F.count_distinct("bc").alias("n_bcs"))
    p = overlaps.join(n, group).withColumn("p", binom_sf("shared", "nx", F.col("ny") / F.col("n_bcs")))
    return p.withColumn("p", F.when(F.col("p") > floor, 1.0).otherwise(F.col("p"))).drop("n_bcs")


def region_distance(fragments: DataFrame, percent: float = 0.8, length: str = "len") -> DataFrame:
    """(distance): how far apart windows must lie to be two events: a percentile of the lengths of all datasets' fragments together; null without any.

    Lengths are counted first, so one row for each distinct length is sorted.
    """
    counts = fragments.where(F.col(length).isNotNull()).groupBy(length).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.percentile(length, F.lit(percent), F.col("n")).alias("distance"))


def significant(overlaps: DataFrame, min_shared: int = 25, max_p: float = 1e-7, off_diagonal: int = 10) -> DataFrame:
    """Pairs with more than ``min_shared`` barcodes, p below ``max_p`` and more than ``off_diagonal`` windows apart, on whichever chromosomes."""
    return overlaps.where((F.col("shared") > min_shared) & (F.col("p") < max_p) & (F.abs(F.col("wx") - F.col("wy")) > off_diagonal))


def sv_regions(overlaps: DataFrame, pairs: DataFrame, scratch: Scratch, group: str = "dataset", window: int = WINDOW) -> DataFrame:
    """(group, chromx, chromy, startx, endx, starty, endy, p, count, best_x, best_y): boxes around pairs that touch, also at corners, with the least p of all ``overlaps`` inside and the windows that have it."""
    on = [group, "chromx", "chromy"]
    cells = scratch.table(pairs.select(*on, "wx", "wy", F.concat_ws("|", *on, F.format_string("%012d|%012d", "wx", "wy")).alias("cell")))
    near = cells.select(*on, F.explode(F.array(*[F.struct((F.col("wx") + a).alias("wx"), (F.col("wy") + b).alias("wy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("at"), F.col("cell").alias("u"))
    near = near.select(*on, "at.wx", "at.wy", "u")
    edges = near.join(cells, [*on, "wx", "wy"]).where("u >= cell").select("u", F.col("cell").alias("v"))
    of = components(edges, scratch).withColumnRenamed("node", "cell")
    boxes = cells.join(of, "cell").groupBy(*on, "component").agg(F.min("wx").alias("ax"), F.max("wx").alias("bx"), F.min("wy").alias("ay"), F.max("wy").alias("by"), F.count(F.lit(1)).alias("count"))
    boxes = scratch.table(boxes)
    inside = overlaps.join(boxes, on).where(F.col("wx").between(F.col("ax"), F.col("bx")) & F.col("wy").between(F.col("ay"), F.col("by")))
    # the cell with the least p, the first by rows of the matrix among equals
    best = inside.groupBy(*on, "component").agg(F.min(F.struct("p", "wy", "wx")).alias("_b")).select(*on, "component", F.col("_b.p").alias("p"), (F.col("_b.wx") * window).alias("best_x"), (F.col("_b.wy") * window).alias("best_y"))
    span = [(F.col(a) * window).alias(n) if n.startswith("start") else ((F.col(a) + 1) * window).alias(n) for a, n in (("ax", "startx"), ("bx", "endx"), ("ay", "starty"), ("by", "endy"))]
    return boxes.join(best, [*on, "component"]).select(*on, *span, "p", "count", "best_x", "best_y")
