"""From regions that share barcodes to breakpoints: histograms of fragment ends, peaks, densities and merged events."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.functions.frames import plain
from fragloom.operators.components import components
from fragloom.session import Scratch

ORIENTATIONS = ("++", "+-", "-+", "--")


def _tips(pairs: DataFrame, regions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every pair once per orientation, with the ends that orientation looks at, from the start of its region."""
    at = lambda s, o: F.col(f"end_{s}") if o == "+" else F.col(f"start_{s}")
    each = F.inline(F.array(*[F.struct(F.lit(o).alias("orientation"), at("x", o[0]).alias("_tx"), at("y", o[1]).alias("_ty")) for o in ORIENTATIONS]))
    rows = pairs.select(*key, "bc", each).join(regions.select(*key, "startx", "endx", "starty", "endy"), list(key))
    return rows.where("_tx BETWEEN startx AND endx AND _ty BETWEEN starty AND endy")


def _bin(tip: str, start: str, end: str, size: int):  # type: ignore[no-untyped-def]
    """Bin of a position; the region's end belongs to the last bin."""
    last = F.ceil((F.col(end) - F.col(start)) / size) - 1
    return F.least(F.floor((F.col(tip) - F.col(start)) / size), last)


def end_histogram(pairs: DataFrame, regions: DataFrame, key: Sequence[str] = ("region_id",), size: int = 10_000) -> DataFrame:
    """(key, orientation, bx, by, n): pairs of fragments by where their ends lie, for each of the four orientations; empty cells have no row."""
    rows = _tips(pairs, regions, key)
    return rows.groupBy(*key, "orientation", _bin("_tx", "startx", "endx", size).alias("bx"), _bin("_ty", "starty", "endy", size).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def background_union(pairs: DataFrame, regions: DataFrame, histogram: DataFrame, key: Sequence[str] = ("region_id",), size: int = 10_000) -> DataFrame:
    """``histogram`` with ``total``: the barcodes that have an end in the cell's x bin or in its y bin."""
    rows = _tips(pairs, regions, key).select(*key, "orientation", "bc", _bin("_tx", "startx", "endx", size).alias("bx"), _bin("_ty", "starty", "endy", size).alias("by"))
    on = [*key, "orientation"]
    xs, ys = rows.select(*on, "bx", "bc").distinct(), rows.select(*on, "by", "bc").distinct()
    nx, ny = xs.groupBy(*on, "bx").agg(F.count(F.lit(1)).alias("nx")), ys.groupBy(*on, "by").agg(F.count(F.lit(1)).alias("ny"))
    cells = histogram.select(*on, "bx", "by")
    common = cells.join(xs, [*on, "bx"]).join(ys, [*on, "by", "bc"]).groupBy(*on, "bx", "by").agg(F.count(F.lit(1)).alias("common"))
    joined = histogram.join(nx, [*on, "bx"]).join(ny, [*on, "by"]).join(common, [*on, "bx", "by"], "left")
    return joined.withColumn("total", F.col("nx") + F.col("ny") - F.coalesce("common", F.lit(0))).drop("nx", "ny", "common")


def overlap_matrix(pairs: DataFrame, regions: DataFrame, key: Sequence[str] = ("region_id",), size: int = 10_000) -> DataFrame:
    """(key, bx, by, n): in how many pairs the x fragment covers bin bx and the y fragment bin by."""
    rows = pairs.join(regions.select(*key, "startx", "endx", "starty", "endy"), list(key))

    def bins(s: str):  # type: ignore[no-untyped-def]
        low = F.greatest(F.floor((F.col(f"start_{s}") - F.col(f"start{s}")) / size), F.lit(0))
        high = F.least(F.floor((F.col(f"end_{s}") - 1 - F.col(f"start{s}")) / size), F.ceil((F.col(f"end{s}") - F.col(f"start{s}")) / size) - 1)
        return F.when(low <= high, F.sequence(low, high))

    return rows.withColumn("bx", F.explode(bins("x"))).withColumn("by", F.explode(bins("y"))).groupBy(*key, "bx", "by").agg(F.count(F.lit(1)).alias("n"))


def peaks(cells: DataFrame, key: Sequence[str] = ("region_id",), min_count: int = 25, min_ratio: float = 0.05, apart: int = 10) -> DataFrame:
    """(key, orientation, bx, by, n, ratio): the cell with the greatest n / total is taken while it has more than both limits; cells within ``apart`` bins of it are out.

    Equal ratios are taken by y, then x. One task works on the cells of one region and orientation, which the region's size bounds.
    """
    names = [*key, "orientation", "bx", "by", "n", "ratio"]
    rows = cells.withColumn("ratio", F.col("n") / F.col("total")).select(*names)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["ratio", "by", "bx"], ascending=[False, True, True])
        out = []
        while len(left) and left["n"].iloc[0] > min_count and left["ratio"].iloc[0] > min_ratio:
            top = left.iloc[0]
            out.append(top)
            left = left[(left["bx"] - top["bx"]).abs().gt(apart) | (left["by"] - top["by"]).abs().gt(apart)]
        return plain(pd.DataFrame(out, columns=names))

    return rows.groupBy(*key, "orientation").applyInPandas(pick, rows.schema)


def steepest_drop(density: np.ndarray, plus: bool) -> int:
    """Where the density falls most for its distance from the peak: right of the peak for ``+``, left of it for ``-``; the first of equals."""
    high = np.flatnonzero(density > 0.9 * density.max())
    if not len(high):
        return 0
    peak = int(high[0] if plus else high[-1])
    at = np.arange(peak + 1, len(density)) if plus else np.arange(0, peak)
    if not len(at):
        return peak
    score = (density[peak] - density[at]) / np.sqrt(np.abs(at - peak))
    return int(at[int(score.argmax())])


def marginal_breakpoints(matrix: DataFrame, regions: DataFrame, key: Sequence[str] = ("region_id",), size: int = 10_000) -> DataFrame:
    """(key, x, y, orientation): where the greatest counts along either side of an overlap matrix fall off most for their distance from the peak.

    ``matrix`` has (key, bx, by, n); bins without a row are 0. Along a side the peak is the first bin with the greatest count;
    the breakpoint is the bin with the greatest (peak - count) / sqrt(distance), the first of equals, at the bin's start; it is
    ``+`` if it lies after the peak. A region without a count has no row. ``regions`` has (key, startx, endx, starty, endy).
    """
    sides = []
    for s in "xy":
        margin = matrix.where("n > 0").groupBy(*key, F.col(f"b{s}").alias("at")).agg(F.max("n").alias("m"))
        known = margin.groupBy(*key).agg(F.max(F.struct("m", (-F.col("at")).alias("at"))).alias("top"), F.collect_list(F.struct("at", "m")).alias("own"))
        bins = regions.select(*key, F.col(f"start{s}").alias("start"), F.ceil((F.col(f"end{s}") - F.col(f"start{s}")) / size).alias("bins"))
        rows = known.join(bins, list(key)).select(*key, "start", "bins", F.col("top.m").alias("top"), (-F.col("top.at")).alias("peak"), F.map_from_entries("own").alias("own"))
        each = rows.select(*key, "start", "top", "peak", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("at"))
        fall = F.when(F.col("at") == F.col("peak"), F.lit(0.0)).otherwise((F.col("top") - F.coalesce(F.element_at("own", F.col("at")), F.lit(0))) / F.sqrt(F.abs(F.col("at") - F.col("peak"))))
        best = each.groupBy(*key).agg(F.max_by(F.struct("at", "peak", "start"), F.struct(fall.alias("fall"), (-F.col("at")).alias("first"))).alias("b"))
        sides.append(best.select(*key, (F.col("b.start") + F.col("b.at") * size).alias(s), F.when(F.col("b.at") > F.col("b.peak"), "+").otherwise("-").alias(f"o{s}")))
    return sides[0].join(sides[1], list(key)).select(*key, "x", "y", F.concat("ox", "oy").alias("orientation"))


def refine_breakends(near: DataFrame, keys: Sequence[str], extend: int = 20_000) -> DataFrame:
    """(keys, pos, new_pos, n): breakends moved to where the coverage of their supporting fragments drops, within ``extend``.

    ``near`` has (keys, pos, orientation, start_pos, end_pos), one row per supporting fragment. The fragments are first brought
    down to where the coverage changes, so a task gets at most two rows per position of a breakend's surroundings.
    """
    low = F.greatest(F.col("start_pos") - F.col("pos") + extend, F.lit(0))
    high = F.least(F.col("end_pos") - F.col("pos") + extend, F.lit(2 * extend + 1))
    steps = near.withColumns({"_low": low, "_high": high}).where("_low < _high").select(*keys, "pos", "orientation", F.inline(F.array(F.struct(F.col("_low").alias("at"), F.lit(1).alias("step")), F.struct(F.col("_high").alias("at"), F.lit(-1).alias("step")))))
    folded = steps.groupBy(*keys, "pos", "orientation", "at").agg(F.sum("step").alias("step"), F.count_if(F.col("step") > 0).alias("opened"))

    def refine(pdf: pd.DataFrame) -> pd.DataFrame:
        change = np.zeros(2 * extend + 2, dtype=np.int64)
        np.add.at(change, pdf["at"].to_numpy(), pdf["step"].to_numpy())
        at = steepest_drop(np.cumsum(change)[:-1], pdf["orientation"].iloc[0] == "+")
        first = plain(pdf.iloc[:1])
        return first[[*keys, "pos"]].assign(new_pos=int(first["pos"].iloc[0]) - extend + at, n=int(pdf["opened"].sum()))

    schema = ", ".join([*(f"`{k}` {t}" for k, t in folded.dtypes if k in keys), "pos bigint, new_pos bigint, n bigint"])
    return folded.groupBy(*keys, "pos", "orientation").applyInPandas(refine, schema)


def cluster_points(events: DataFrame, scratch: Scratch, distance: int = 5_000, key: str = "event_id") -> DataFrame:
    """(key, cluster): events of one chromosome pair and orientation, linked where (x, y) lie less than ``distance`` apart.

    Points of one cell, whose diagonal is below the distance, hang on the cell's least point; only cells close by are compared
    point by point, over distinct points.
    """
    on = ["chromx", "chromy", "orientation"]
    side = max(1, int(distance / 2**0.5) - 1)
    rows = events.where("x IS NOT NULL AND y IS NOT NULL").select(key, *on, "x", "y")
    points = rows.groupBy(*on, "x", "y").agg(F.min(key).alias("p")).withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    points = scratch.table(points)
    heads = points.groupBy(*on, "cx", "cy").agg(F.min("p").alias("v"))
    inside = points.join(heads, [*on, "cx", "cy"]).select(F.col("p").alias("u"), "v")
    steps = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)]
    moved = points.select(*on, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("p").alias("u"), F.inline(F.array(*[F.struct((F.col("cx") + a).alias("cx"), (F.col("cy") + b).alias("cy")) for a, b in steps])))
    close = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) < distance * distance
    across = moved.join(points, [*on, "cx", "cy"]).where(close).select("u", F.col("p").alias("v"))
    of = components(inside.unionByName(across), scratch).select(F.col("node").alias("p"), F.col("component").alias("cluster"))
    return rows.join(points.select(*on, "x", "y", "p"), [*on, "x", "y"]).join(of, "p").select(key, "cluster")


def combine_events(events: DataFrame, clusters: DataFrame, key: str = "event_id") -> DataFrame:
    """(cluster, chromx, x, chromy, y, orientation, n): one event for each cluster, at the mean cut to a whole number."""
    rows = events.join(clusters, key)
    whole = lambda c: F.floor(F.avg(c)).cast("bigint").alias(c)
    return rows.groupBy("cluster", "chromx", "chromy", "orientation").agg(whole("x"), whole("y"), F.count(F.lit(1)).alias("n"))
