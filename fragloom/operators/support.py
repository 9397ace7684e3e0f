"""Which fragments support a breakpoint, in how many barcodes, and how likely that is by chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.functions.stats import binom_sf
from fragloom.functions.text import facing
from fragloom.operators.rangejoin import overlap_join
from fragloom.operators.tips import Tips
from fragloom.session import Scratch

BIN = 20_000


def breakends(events: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, side, chrom, pos, orientation): both ends of every event (chromx, x, chromy, y, orientation of two characters)."""
    end = lambda s, i: F.struct(F.lit(s).alias("side"), F.col(f"chrom{s}").alias("chrom"), F.col(s).alias("pos"), F.substring("orientation", i, 1).alias("orientation"))
    return events.select(key, F.inline(F.array(end("x", 1), end("y", 2)))).where("chrom IS NOT NULL AND pos IS NOT NULL")


def near_breakends(ends: DataFrame, fragments: DataFrame, keys: Sequence[str], near: int, far: int, columns: Sequence[str] = ("dataset", "frag_id", "bc", "hap", "start_pos", "end_pos")) -> DataFrame:
    """Fragments that end (``+``) or start (``-``) within ``near`` to ``far`` of a breakend, on its side.

    For ``+`` that is from p - far, excluded, to p - near; for ``-`` from p + near to p + far. Ranges start at 0 at least.
    """
    left = F.col("orientation") == "+"
    low = F.when(left, F.greatest(F.col("pos") - far + 1, F.lit(0))).otherwise(F.greatest(F.col("pos") + near, F.lit(0)))
    high = F.when(left, F.col("pos") - near).otherwise(F.col("pos") + far)
    spans = ends.where(F.col("orientation").isin("+", "-")).select(*keys, "chrom", "pos", "orientation", low.alias("_from"), high.alias("_to"))
    tips = fragments.where("end_pos > start_pos AND bc IS NOT NULL").select("chrom", *columns, F.explode(F.array(F.struct(F.lit("+").alias("tip"), F.col("end_pos").alias("at")), F.struct(F.lit("-").alias("tip"), F.col("start_pos").alias("at")))).alias("_t"))
    tips = tips.select("chrom", *columns, F.col("_t.tip").alias("orientation"), F.col("_t.at").alias("_at"), F.col("_t.at").alias("_until"))
    return overlap_join(spans, tips, ["chrom", "orientation"], ("_from", "_to"), ("_at", "_until"), BIN).drop("_from", "_to", "_until").withColumnRenamed("_at", "tip")


def support_by_barcode(events: DataFrame, fragments: DataFrame, near: int = -500, far: int = 5_000, key: str = "event_id", group: str = "dataset") -> DataFrame:
    """Per (event, group, barcode) how many fragments lie on either side, without barcodes that only have one molecule across both.

    nx and ny count fragments, ``same`` those on both sides; hx0, hx1, hy0, hy1 count by haplotype (0 or 2, and 1), with
    ``_same`` for those on both. A barcode with one fragment that is on both sides supports neither.
    """
    rows = near_breakends(breakends(events, key), fragments, [key, "side"], near, far)
    on = lambda s: F.max(F.when(F.col("side") == s, 1).otherwise(0))
    each = rows.groupBy(key, group, "bc", "frag_id").agg(on("x").alias("in_x"), on("y").alias("in_y"), F.max(F.when(F.col("hap").isin(0, 2), 1).otherwise(0)).alias("h0"), F.max(F.when(F.col("hap") == 1, 1).otherwise(0)).alias("h1"))
    both = F.col("in_x") * F.col("in_y")
    sums = [F.sum("in_x").alias("nx"), F.sum("in_y").alias("ny"), F.sum(both).alias("same")]
    for s in "xy":
        for h in "01":
            sums += [F.sum(F.col(f"in_{s}") * F.col(f"h{h}")).alias(f"h{s}{h}"), F.sum(both * F.col(f"h{h}")).alias(f"h{s}{h}_same")]
    per = each.groupBy(key, group, "bc").agg(*sums)
    return per.where("NOT (nx = 1 AND ny = 1 AND same = 1)")


def quantify(events: DataFrame, fragments: DataFrame | Tips, near: int = -500, far: int = 5_000, key: str = "event_id", group: str = "dataset") -> DataFrame:
    """(event, group, shared, total, only_x, only_y, p_fisher, x_hap0, x_hap1, y_hap0, y_hap1): barcodes on both sides, on either, and the exact test.

    The haplotypes count merged rows, that is pairs of an x and a y fragment of one barcode that are not the same fragment.
    A group in which an event has no barcode at all has no row. Several calls on the same fragments may share their tips.
    """
    tips = fragments if isinstance(fragments, Tips) else Tips(fragments, group)
    return tips.quantify(events, breakends(events, key), near, far, key)


def roll_up_samples(quantified: DataFrame, key: str = "event_id", p: str = "p_fisher", max_p: float = 1e-4, min_ratio: float = 0.10) -> DataFrame:
    """(event, shared, total, p): sums over the samples that pass both limits, and the least p of all, 1 where it is missing."""
    passes = (F.col(p) < max_p) & (F.col("shared") > F.col("total") * min_ratio)
    add = lambda c: F.coalesce(F.sum(F.when(passes, F.col(c))), F.lit(0))
    return quantified.groupBy(key).agg(add("shared").alias("shared"), add("total").alias("total"), F.min(F.coalesce(p, F.lit(1.0))).alias("p"))


def fragment_pairs(regions: DataFrame, fragments: DataFrame, key: Sequence[str] = ("region_id",)) -> DataFrame:
    """Pairs of fragments of one barcode and dataset, one in each side of a region (chromx, startx, endx, chromy, starty, endy), that are not the same fragment."""

    def side(s: str) -> DataFrame:
        spans = regions.select(*key, "dataset", F.col(f"chrom{s}").alias("chrom"), F.col(f"start{s}").alias("_a"), F.col(f"end{s}").alias("_b"))
        found = overlap_join(spans, fragments.select("dataset", "chrom", "bc", "frag_id", "start_pos", "end_pos"), ["dataset", "chrom"], ("_a", "_b"), ("start_pos", "end_pos"), BIN)
        return found.select(*key, "dataset", "bc", F.col("frag_id").alias(f"frag_{s}"), F.col("start_pos").alias(f"start_{s}"), F.col("end_pos").alias(f"end_{s}"))

    return side("x").join(side("y"), [*key, "dataset", "bc"]).where("frag_x <> frag_y")


def pair_evidence(ends: DataFrame, n_barcodes: DataFrame, min_shared: int = 15, min_ratio: float = 0.01) -> DataFrame:
    """(dataset, chromx, x, ox, chromy, y, oy, shared, total, p, facing): breakends with many barcodes in common.

    ``ends`` has one row per (dataset, chrom, pos, orientation, bc). Pairs are made over barcodes as in the window overlaps:
    two breakends that share ``min_shared`` of them share one outside the ``min_shared - 1`` most frequent of either.
    ``n_barcodes`` has the number of barcodes of each dataset as ``n_bcs``.
    """
    scratch = Scratch(ends.sparkSession, "evidence")
    ends = scratch.table(ends.select("dataset", "chrom", "pos", "orientation", "bc").distinct())
    node = ["dataset", "chrom", "pos", "orientation"]
    freq = scratch.table(ends.groupBy("dataset", "bc").agg(F.count(F.lit(1)).alias("f")).withColumn("id", F.monotonically_increasing_id()))
    sets = ends.join(freq, ["dataset", "bc"]).groupBy(*node).agg(F.array_sort(F.collect_list(F.struct("f", "id"))).alias("own")).where(F.size("own") >= min_shared)
    sets = scratch.table(sets.select(*node, F.col("own.id").alias("bcs")))
    rare = sets.select(*node, F.explode(F.slice("bcs", F.lit(1), F.size("bcs") - min_shared + 1)).alias("bc"))
    x = rare.select("dataset", "bc", *[F.col(a).alias(b) for a, b in (("chrom", "chromx"), ("pos", "x"), ("orientation", "ox"))])
    y = rare.select("dataset", "bc", *[F.col(a).alias(b) for a, b in (("chrom", "chromy"), ("pos", "y"), ("orientation", "oy"))])
    before = F.struct("chromx", "x", "ox") < F.struct("chromy", "y", "oy")
    pairs = x.join(y, ["dataset", "bc"]).where(before).drop("bc").distinct()
    sx = sets.select("dataset", F.col("chrom").alias("chromx"), F.col("pos").alias("x"), F.col("orientation").alias("ox"), F.col("bcs").alias("bx"))
    sy = sets.select("dataset", F.col("chrom").alias("chromy"), F.col("pos").alias("y"), F.col("orientation").alias("oy"), F.col("bcs").alias("by"))
    both = pairs.join(sx, ["dataset", "chromx", "x", "ox"]).join(sy, ["dataset", "chromy", "y", "oy"])
    nx, ny = F.size("bx").cast("bigint"), F.size("by").cast("bigint")
    counted = both.withColumns({"shared": F.size(F.array_intersect("bx", "by")).cast("bigint"), "ny": ny}).withColumn("total", nx + ny - F.col("shared")).drop("bx", "by")
    kind = facing(F.col("chromx"), F.col("x"), F.col("ox"), F.col("chromy"), F.col("y"), F.col("oy"))
    kept = counted.where((F.col("shared") >= min_shared) & (F.col("shared") > F.col("total") * min_ratio)).withColumn("facing", kind).where("facing <> 'bad'")
    return kept.join(n_barcodes, "dataset").withColumn("p", binom_sf("shared", "total", F.col("ny") / F.col("n_bcs"))).drop("ny", "n_bcs")
