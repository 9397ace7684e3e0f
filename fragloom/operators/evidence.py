"""Further evidence for events: resampled overlaps, shared read names, pileups, covered bases and walks along contigs."""

from __future__ import annotations

from collections.abc import Sequence
from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fragloom.functions.frames import plain
from fragloom.operators.coverage import merge_intervals
from fragloom.operators.rangejoin import overlap_join
from fragloom.operators.support import breakends
from fragloom.session import Scratch

DECOY = "(?i)gl|hap|un|_"


def signed_rank_less(samples: np.ndarray, observed: float) -> float:
    """One-sided signed-rank test, in its normal form with ties, that the samples lie below what was observed; NaN if all equal it."""
    d = samples - observed
    d = d[d != 0]
    n = len(d)
    if not n:
        return float("nan")
    values, place, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[place]
    up = ranks[d > 0].sum()
    t = min(up, ranks.sum() - up)
    spread = sqrt((n * (n + 1) * (2 * n + 1) - (counts**3 - counts).sum() / 2) / 24)
    both = erfc(abs(t - n * (n + 1) / 4) / spread / sqrt(2)) if spread else 1.0
    return 1 - both / 2 if samples.mean() > observed else both / 2


def draws(rng: np.random.Generator, weights: np.ndarray, counts: np.ndarray, n: int, times: int) -> np.ndarray:
    """(times, classes): how many of each weight are among n drawn without replacement, where each comes up after an exponential time and the first n count.

    Exact: how many of a class come up within a time is binomial, and so is how many of those come up within a part of it. So
    times are halved, in which what came up is shared out, until one is found by which just n have come up.
    """
    n = min(n, int(counts.sum()))
    end = 1.0
    while (counts * -np.expm1(-weights * end)).sum() < n and end < 1e12:
        end *= 2
    low, high = np.zeros((times, len(counts)), dtype=np.int64), np.empty((times, len(counts)), dtype=np.int64)
    since, until = np.zeros(times), np.full(times, end)
    high[:] = rng.binomial(counts, -np.expm1(-weights * end), (times, len(counts)))
    while len(short := np.flatnonzero(high.sum(axis=1) < n)):
        low[short], since[short] = high[short], until[short]
        until[short] *= 2
        more = -np.expm1(-weights * (until - since)[short, None])
        high[short] += rng.binomial(counts - low[short], np.where(weights > 0, more, 1.0))
    low[high.sum(axis=1) == n] = high[high.sum(axis=1) == n]
    while len(wide := np.flatnonzero(low.sum(axis=1) != n)):
        span, middle = (until - since)[wide], (since + until)[wide] / 2
        between = high[wide] - low[wide]
        same = wide[span <= 1e-14 * until[wide]]
        if len(same):  # at one and the same time: any of them as likely as another
            for r in same:
                low[r] += rng.multivariate_hypergeometric(high[r] - low[r], n - int(low[r].sum()))
            continue
        first = np.expm1(-weights * (span / 2)[:, None]) / np.minimum(np.expm1(-weights * span[:, None]), -1e-300)
        now = low[wide] + rng.binomial(between, np.clip(first, 0.0, 1.0))
        enough = now.sum(axis=1) >= n
        high[wide[enough]], until[wide[enough]] = now[enough], middle[enough]
        low[wide[~enough]], since[wide[~enough]] = now[~enough], middle[~enough]
        done = wide[high[wide].sum(axis=1) == n]
        low[done] = high[done]
    return low


def _draw(rng: np.random.Generator, weights: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    return draws(rng, weights, counts, n, 1)[0]


class _Resampler:
    """Numbers that two draws have in common, for the barcodes of one group; the draws of a size are made once.

    A smaller draw is part of a larger one, as long as barcodes are many beside it; beyond that each size has its own.
    """

    BLOCK = 1 << 12

    def __init__(self, reads: np.ndarray, n: np.ndarray, resamples: int, seed: int):
        self.weights, self.n = reads / float((reads * n).sum()), n
        self.resamples, self.seed = resamples, seed
        self.made: dict[tuple[int, int], np.ndarray] = {}
        self.most = max(2, 20_000_000 // (resamples * len(n)))

        # sizes that so many draws with replacement are expected to hold twice are taken from those
        self.nested = float((n * -np.expm1(8 * self.BLOCK * np.log1p(-np.minimum(self.weights, 1 - 1e-16)))).sum()) / 2
        self.rngs = [np.random.default_rng([seed, side]) for side in (0, 1)]
        self.firsts: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] * resamples for _ in (0, 1)]

    def first(self, side: int, size: int) -> np.ndarray:
        """(resamples, size): the classes of the first different barcodes in draws with replacement, which is how draws without it come out."""
        own, rng = self.firsts[side], self.rngs[side]
        upto, before = np.cumsum(self.weights * self.n), np.cumsum(self.n) - self.n
        while min(map(len, own)) < size:
            at = np.minimum(np.searchsorted(upto, rng.random((self.resamples, self.BLOCK)) * upto[-1], "right"), len(upto) - 1)
            which = before[at] + np.minimum(rng.random(at.shape) * self.n[at], self.n[at] - 1).astype(np.int64)
            for r in range(self.resamples):
                row = np.concatenate((own[r], which[r]))
                own[r] = row[np.sort(np.unique(row, return_index=True)[1])]
        return np.searchsorted(before, np.stack([v[:size] for v in own]), "right") - 1

    def of(self, side: int, size: int) -> np.ndarray:
        if (side, size) not in self.made:
            if len(self.made) >= self.most:
                self.made.clear()
            if size <= self.nested:
                cell = self.first(side, size) + np.arange(self.resamples)[:, None] * len(self.n)
                made = np.bincount(cell.ravel(), minlength=self.resamples * len(self.n)).reshape(self.resamples, len(self.n))
            else:
                made = draws(np.random.default_rng([self.seed, side, size]), self.weights, self.n, size, self.resamples)
            self.made[side, size] = made
        return self.made[side, size]

    def common(self, nx: int, ny: int) -> np.ndarray:
        x, y = self.of(0, nx), self.of(1, ny)
        at = np.nonzero((x > 0) & (y > 0))
        # barcodes with equal reads are alike: what two draws have in common of them is hypergeometric
        found = np.random.default_rng([self.seed, 2, nx, ny]).hypergeometric(x[at], self.n[at[1]] - x[at], y[at])
        return np.bincount(at[0], weights=found, minlength=self.resamples)


def resampling_p(quantified: DataFrame, totals: DataFrame, resamples: int = 100, seed: int = 0, key: str = "event_id", group: str = "dataset", share: int = 5_000) -> DataFrame:
    """``quantified`` with ``p_resampling``: how the barcodes two sides share compare with those of draws of as many barcodes, weighted by their reads.

    Barcodes with equal reads are exchangeable, so a draw only needs how many of each number of reads it holds. ``totals``
    (group, bc, num_reads) is brought down to that, of which a group has at most the root of twice its reads, and each task
    gets it beside ``share`` pairs of sizes of the group. Draws, and what two have in common, depend on the seed and their sizes
    alone, so each pair of sizes is drawn once, however many events have it. A p is null where no draw differs from what was found, and where a group has no reads.
    """
    scratch = Scratch(quantified.sparkSession, "resampling")
    counts = scratch.table(totals.where("num_reads > 0").groupBy(group, "num_reads").agg(F.count(F.lit(1)).alias("n")))
    quantified = scratch.table(quantified)
    sizes = scratch.table(quantified.where(F.col(group).isNotNull()).groupBy(group, "only_x", "only_y", "shared").agg(F.lit(1).alias("_one")).drop("_one"))
    tasks = sizes.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / share).alias("_tasks"))
    left = sizes.join(tasks, group).withColumn("_task", F.pmod(F.xxhash64(F.col("shared") + F.col("only_x")), F.col("_tasks"))).drop("_tasks")
    right = counts.join(tasks, group).select(group, "num_reads", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_tasks") - 1)).alias("_task"))

    def test(found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = plain(found).drop(columns="_task")
        p = np.full(len(out), np.nan)
        if len(out) and len(own):
            own = own.sort_values("num_reads")
            sampler = _Resampler(own["num_reads"].to_numpy(), own["n"].to_numpy(), resamples, seed)
            shared = out["shared"].to_numpy()
            nx, ny = shared + out["only_x"].to_numpy(), shared + out["only_y"].to_numpy()
            last, drawn = None, None
            for i in np.lexsort((ny, nx)):
                if last != (last := (int(nx[i]), int(ny[i]))):
                    drawn = sampler.common(*last)
                p[i] = signed_rank_less(drawn, float(shared[i]))
        return out.assign(p_resampling=pd.Series(p, index=out.index, dtype=object).where(~np.isnan(p), None))

    schema = StructType([*left.drop("_task").schema, StructField("p_resampling", DoubleType())])
    tested = scratch.table(left.groupBy(group, "_task").cogroup(right.groupBy(group, "_task")).applyInPandas(test, schema))
    return quantified.join(tested, [group, "only_x", "only_y", "shared"]).select(*quantified.columns, "p_resampling")


def cap_barcodes(barcodes: DataFrame, most: int | None = None, key: Sequence[str] = ("event_id",)) -> DataFrame:
    """All barcodes of each event, or a sample of ``most``, chosen by a hash, the same in every run."""
    if most is None:
        return barcodes
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("bc"), "bc"))
    return barcodes.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def shared_read_names(events: DataFrame, reads: DataFrame, max_insert: int, imprecision: int = 0, backwards: bool = False, min_mapq: int = 55, key: str = "event_id") -> DataFrame:
    """(key, common, total): names of reads on both and on either side of an event, within twice the insert size, pointing at it (or away, ``backwards``)."""
    ends = breakends(events, key).where("orientation IN ('+', '-')")
    plus, extend = F.col("orientation") == "+", 2 * max_insert + imprecision
    low = F.greatest(F.when(plus, F.col("pos") - extend).otherwise(F.col("pos") - imprecision), F.lit(0))
    high = F.greatest(F.when(plus, F.col("pos") + imprecision).otherwise(F.col("pos") + extend), F.lit(0))
    reverse = ~plus if backwards else plus
    spans = ends.select(key, "side", "chrom", reverse.alias("is_reverse"), low.alias("_a"), (high - 1).alias("_b"))
    good = reads.where((F.col("mapq") >= min_mapq) & ~F.col("is_secondary") & ~F.col("is_supplementary")).select("chrom", "is_reverse", "read_name", F.col("pos").alias("_c"), (F.col("ref_end") - 1).alias("_d"))
    hits = overlap_join(spans, good, ["chrom", "is_reverse"], ("_a", "_b"), ("_c", "_d"), max(1_000, extend))
    names = hits.groupBy(key, "read_name").agg(F.count_distinct("side").alias("sides"))
    return names.groupBy(key).agg(F.count_if(F.col("sides") == 2).alias("common"), F.count(F.lit(1)).alias("total"))


def pileup(alignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, chrom, pos, base, n): bases of alignments (by, chrom, pos, flag, cigar, seq) at every reference position they match.

    Unmapped, secondary and duplicate reads and those that failed quality control don't count, nor do deleted bases; without a
    ``flag`` all count. Null flags count as 0.
    """
    start = "named_struct('q', 0L, 'r', 0L, 'out', cast(array() as array<struct<op:string,len:bigint,q:bigint,r:bigint>>))"
    step = """(a, o) -> named_struct('q', a.q + IF(o.op IN ('M', 'I', 'S', '=', 'X'), o.len, 0L), 'r', a.r + IF(o.op IN ('M', 'D', 'N', '=', 'X'), o.len, 0L),
              'out', array_append(a.out, named_struct('op', o.op, 'len', o.len, 'q', a.q, 'r', a.r)))"""
    good = F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(F.lit(4 | 256 | 512 | 1024)) == 0 if "flag" in alignments.columns else F.lit(True)
    parts = alignments.where("chrom IS NOT NULL").where(good).select(*by, "chrom", "pos", "seq", F.expr(f"inline(aggregate(cigar, {start}, {step}, a -> a.out))")).where("op IN ('M', '=', 'X') AND len > 0")
    bases = parts.select(*by, "chrom", "pos", "seq", "q", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1)).alias("i"))
    return bases.groupBy(*by, "chrom", (F.col("pos") + F.col("r") + F.col("i")).alias("pos"), F.substr("seq", (F.col("q") + F.col("i") + 1).cast("int"), F.lit(1)).alias("base")).agg(F.count(F.lit(1)).alias("n"))


def variant_positions(piled: DataFrame, reference: DataFrame, more_than: float = 0.2, size: int = 100_000, by: Sequence[str] = ()) -> DataFrame:
    """(by, chrom, pos, frac): positions where more than so much of the bases differ from the reference (chrom, bin, seq)."""
    at = piled.withColumn("bin", F.expr(f"pos div {size}")).join(reference, ["chrom", "bin"])
    ref = F.upper(F.substr("seq", (F.col("pos") - F.col("bin") * size + 1).cast("int"), F.lit(1)))
    per = at.withColumn("_ref", ref).groupBy(*by, "chrom", "pos").agg((F.sum(F.when(F.upper("base") != F.col("_ref"), F.col("n")).otherwise(0)) / F.sum("n")).alias("frac"))
    return per.where(F.col("frac") > more_than)


def nearby_variants(events: DataFrame, variants: DataFrame, around: int = 500, key: str = "event_id", group: str = "dataset") -> DataFrame:
    """(key, nearby_snvs) of every event: ``variants`` (group, chrom, pos) from ``around`` before each breakend to just before ``around`` after it.

    Of each side the group with most counts, and both sides add up; a missing side adds nothing.
    """
    ends = breakends(events, key)
    spans = ends.select(key, "side", "chrom", F.greatest(F.col("pos") - around, F.lit(0)).alias("_a"), (F.col("pos") + around - 1).alias("_b"))
    own = variants.select(group, "chrom", F.col("pos").alias("_c"), F.col("pos").alias("_d")).distinct()
    per = overlap_join(spans, own, ["chrom"], ("_a", "_b"), ("_c", "_d"), around * 4).groupBy(key, "side", group).agg(F.count(F.lit(1)).alias("n"))
    sides = per.groupBy(key, "side").agg(F.max("n").alias("n")).groupBy(key).agg(F.sum("n").alias("n"))
    return events.select(key).distinct().join(sides, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("nearby_snvs"))


def reference_stretches(spans: DataFrame, reference: DataFrame, keys: Sequence[str], size: int = 100_000) -> DataFrame:
    """(keys, seq): the reference's bases from ``start`` to before ``end`` of each span (keys, chrom, start, end), in upper case.

    ``reference`` has (chrom, bin, seq) in pieces of ``size``. Spans are cut at the reference's ends; one without a base has no row.
    """
    low = F.greatest(F.col("start"), F.lit(0))
    rows = spans.where("end > start AND end > 0").select(*keys, "chrom", low.alias("_a"), F.col("end").alias("_b"))
    rows = rows.withColumn("bin", F.explode(F.sequence(F.expr(f"_a div {size}"), F.expr(f"(_b - 1) div {size}"))))
    base = F.col("bin") * size
    first, last = F.greatest(F.col("_a") - base, F.lit(0)), F.least(F.col("_b") - base, F.lit(size))
    cut = rows.join(reference.select("chrom", "bin", "seq"), ["chrom", "bin"]).select(*keys, "bin", F.upper(F.substr("seq", (first + 1).cast("int"), (last - first).cast("int"))).alias("seq"))
    whole = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "seq"))).alias("_p"))
    return whole.select(*keys, F.array_join(F.col("_p.seq"), "").alias("seq")).where("seq <> ''")


def nearby_unknown(events: DataFrame, reference: DataFrame, around: int = 5_000, key: str = "event_id", size: int = 100_000) -> DataFrame:
    """(key, nearby_n) of every event: the unknown bases of the reference within ``around`` of a breakend, of the side that has more."""
    ends = breakends(events, key).select(key, "side", "chrom", (F.col("pos") - around).alias("start"), (F.col("pos") + around).alias("end"))
    n = F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))
    most = reference_stretches(ends, reference, [key, "side"], size).groupBy(key).agg(F.max(n).cast("bigint").alias("n"))
    return events.select(key).distinct().join(most, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("nearby_n"))


def covered_bases(fragments: DataFrame, reads: DataFrame, key: Sequence[str], on: Sequence[str] = ("chrom", "bc")) -> DataFrame:
    """(key, covered): positions of each fragment under at least one read of its barcode; fragments without one have no row."""
    spans = fragments.select(*key, *[c for c in on if c not in key], F.col("start_pos").alias("_a"), (F.col("end_pos") - 1).alias("_b")).where("_a <= _b")
    own = reads.select(*on, F.col("pos").alias("_c"), (F.col("ref_end") - 1).alias("_d"))
    hits = overlap_join(spans, own, list(on), ("_a", "_b"), ("_c", "_d"), 100_000)
    clipped = hits.select(*key, F.greatest("_a", "_c").alias("_from"), (F.least("_b", "_d") + 1).alias("_to"))
    return merge_intervals(clipped, key, "_from", "_to").groupBy(*key).agg(F.sum(F.col("stretch_end") - F.col("stretch_start")).alias("covered"))


def contig_walks(starts: DataFrame, contigs: DataFrame, gap: int = 4_000, reach: int = 10_000, meet: int = 20, back: int = 5_000) -> DataFrame:
    """(cluster, start_id, step, chromx, x, orientationx, chromy, y, orientationy, contig): links from alignment to alignment of a contig.

    ``starts`` (cluster, start_id, chrom, pos) are walked in both directions over ``contigs``, the alignments of a cluster's
    contigs: (cluster, contig, chrom, start, end, q_start, q_end, clip_left, clip_right), with the contig's coordinates at the
    start and end on the reference, and whether more than 40 bases are unaligned there. A walk goes on along alignments until
    a gap of more than ``gap``; the furthest one must be clipped, and the walk jumps to another, non-overlapping alignment of
    that contig whose coordinate meets it within ``meet``. It stops at decoy contigs and where it has been. One task walks the
    contigs of one cluster, which come from one assembly: what an assembler takes in for it bounds them.
    """
    schema = "cluster string, start_id bigint, step bigint, chromx string, x bigint, orientationx string, chromy string, y bigint, orientationy string, contig string"
    names = [c.split()[0] for c in schema.split(", ")]

    def furthest(own: pd.DataFrame, chrom: str, pos: int, plus: bool):  # type: ignore[no-untyped-def]
        here = own[(own["chrom"] == chrom) & ((own["end"] >= pos) if plus else (own["start"] <= pos))]
        best = None
        edge = pos + reach if plus else pos - reach
        for a in here.sort_values("start" if plus else "end", ascending=plus).itertuples():
            if (a.start > edge) if plus else (a.end < edge):
                break
            if best is None or ((a.end > best.end) if plus else (a.start < best.start)):
                best = a
                edge = a.end + gap if plus else a.start - gap
        return best

    def chain(own: pd.DataFrame, chrom: str, pos: int, plus: bool) -> list[tuple]:
        out, seen = [], set()
        while (a := furthest(own, chrom, pos, plus)) is not None and (a.clip_right if plus else a.clip_left):
            q = a.q_end if plus else a.q_start
            jump = None
            for b in own[own["contig"] == a.contig].itertuples():
                if b.Index == a.Index or (b.chrom == a.chrom and b.start <= a.end and a.start <= b.end):
                    continue
                jump = next(((b, o) for o in "+-" if abs((b.q_end if o == "+" else b.q_start) - q) < meet), None)
                if jump:
                    break
            if not jump:
                break
            b, o = jump
            middle = (b.start + b.end) // 2
            if pd.Series([b.chrom]).str.contains(DECOY).iloc[0] or (b.chrom, middle, o) in seen:
                break
            seen.add((b.chrom, middle, o))
            out.append((a.chrom, a.end if plus else a.start, "+" if plus else "-", b.chrom, b.end if o == "+" else b.start, o, a.contig))
            chrom, pos, plus = b.chrom, middle, o == "-"
        return out

    def walk(begin: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["contig", "chrom", "start", "end"]).reset_index(drop=True)
        rows = []
        for s in begin.sort_values("start_id").itertuples():
            left = [(*k[3:6], *k[:3], k[6]) for k in reversed(chain(own, s.chrom, s.pos + back, False))]
            links = left + chain(own, s.chrom, max(0, s.pos - back), True)
            rows += [(s.cluster, s.start_id, i, *k) for i, k in enumerate(links)]
        return pd.DataFrame(rows, columns=names)

    return starts.groupBy("cluster").cogroup(contigs.groupBy("cluster")).applyInPandas(walk, schema)
