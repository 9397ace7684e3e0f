"""Joint genotyping of events: fragment lengths, blacklists, neighbourhood, quality, presence per sample and classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragloom.functions.text import natural_key, percent
from fragloom.operators.rangejoin import nearest_join, overlap_join
from fragloom.operators.support import breakends, near_breakends

QUANTILES = (0.2, 0.5, 0.8)


def background_lengths(fragments: DataFrame, chroms: DataFrame, skip: int = 1_000_000, least: int = 5, group: str = "dataset") -> DataFrame:
    """(group, chrom, locus, len): lengths of the fragments strictly across each multiple of ``skip``; loci with fewer than ``least`` are out."""
    first, last = F.expr(f"start_pos div {skip} + 1"), F.expr(f"(end_pos - 1) div {skip}")
    rows = fragments.where("end_pos > start_pos").select(group, "chrom", (F.col("end_pos") - F.col("start_pos")).alias("len"), first.alias("a"), last.alias("b")).where("a <= b")
    loci = rows.withColumn("locus", F.explode(F.transform(F.sequence("a", "b"), lambda i: i * skip))).join(chroms.select("chrom", "length"), "chrom").where("locus < length")
    enough = loci.groupBy(group, "chrom", "locus").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
    return loci.join(enough, [group, "chrom", "locus"]).select(group, "chrom", "locus", "len")


def background_or_denser(fragments: DataFrame, chroms: DataFrame, skip: int = 1_000_000, denser: int = 50_000, least: int = 5, group: str = "dataset") -> DataFrame:
    """``background_lengths``, taken every ``denser`` positions instead for groups with fewer than two loci."""
    first = background_lengths(fragments, chroms, skip, least, group)
    enough = first.select(group, "chrom", "locus").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(group)
    again = background_lengths(fragments.join(enough, group, "left_anti"), chroms, denser, least, group)
    return first.join(enough, group, "left_semi").unionByName(again)


def length_bands(lengths: DataFrame, group: str = "dataset") -> DataFrame:
    """(group, low_20, high_20, low_50, high_50, low_80, high_80): 2.5 to 97.5 % bands over loci of each quantile of their lengths.

    Loci whose number of fragments or whose median lies outside the loci's own 2.5 to 97.5 % band, or on its edge, don't count.
    """
    q = F.percentile("len", F.array(*[F.lit(x) for x in QUANTILES]))
    loci = lengths.groupBy(group, "chrom", "locus").agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    band = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    by_size = loci.join(loci.groupBy(group).agg(band("n").alias("bn")), group).where("n > bn[0] AND n < bn[1]")
    medians = loci.groupBy(group).agg(band(F.col("q")[1]).alias("bm"))
    kept = by_size.join(medians, group).where("q[1] > bm[0] AND q[1] < bm[1]")
    bands = [band(F.col("q")[i]).alias(f"b{int(x * 100)}") for i, x in enumerate(QUANTILES)]
    edges = [F.col(f"b{int(x * 100)}")[i].alias(f"{n}_{int(x * 100)}") for x in QUANTILES for i, n in enumerate(("low", "high"))]
    return kept.groupBy(group).agg(*bands).select(group, *edges)


def joined_lengths(events: DataFrame, fragments: DataFrame, near: int = -500, far: int = 5_000, key: str = "event_id", group: str = "dataset") -> DataFrame:
    """(key, group, bc, len): for each merged pair the length of the molecule across the event: from the far ends of both fragments to the breakends."""
    rows = near_breakends(breakends(events, key), fragments, [key, "side"], near, far)
    part = F.when(F.col("orientation") == "+", F.col("pos") - F.col("start_pos")).otherwise(F.col("end_pos") - F.col("pos"))
    sided = rows.select(key, group, "bc", "side", "frag_id", part.alias("part")).distinct()
    x = sided.where("side = 'x'").select(key, group, "bc", F.col("frag_id").alias("fx"), F.col("part").alias("px"))
    y = sided.where("side = 'y'").select(key, group, "bc", F.col("frag_id").alias("fy"), F.col("part").alias("py"))
    return x.join(y, [key, group, "bc"]).where("fx <> fy").select(key, group, "bc", (F.col("px") + F.col("py")).alias("len"))


def length_test(lengths: DataFrame, bands: DataFrame, least: int = 5, lenient: bool = False, key: str = "event_id", group: str = "dataset") -> DataFrame:
    """(key, group, lengths_50, lengths_90, passes): whether every quantile lies strictly inside its band; null with fewer than ``least`` rows.

    The outer two bands are widened by 5 %; ``lenient`` widens all of them by as much again.
    """
    q = F.percentile("len", F.array(*[F.lit(x) for x in (*QUANTILES, 0.9)]))
    per = lengths.groupBy(key, group).agg(F.count(F.lit(1)).alias("n"), q.alias("q")).join(bands, group, "left")
    inside: Column = F.lit(True)
    for i, x in enumerate(QUANTILES):
        low, high = (0.95, 1.05) if x != 0.5 else (1.0, 1.0)
        low, high = (low * 0.95, high * 1.05) if lenient else (low, high)
        name = int(x * 100)
        inside = inside & (F.col("q")[i] > F.col(f"low_{name}") * low) & (F.col("q")[i] < F.col(f"high_{name}") * high)
    return per.select(key, group, F.col("q")[1].alias("lengths_50"), F.col("q")[3].alias("lengths_90"), F.when(F.col("n") >= least, inside).alias("passes"))


def length_filter(tested: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, frag_length_passes): whether any sample passes."""
    return tested.groupBy(key).agg(F.coalesce(F.max("passes"), F.lit(False)).alias("frag_length_passes"))


def blacklist_hits(events: DataFrame, blacklist: DataFrame, within: int = 10_000, key: str = "event_id") -> DataFrame:
    """(key, blacklist): the reasons of the intervals nearest to either side, below ``within`` away, sorted and joined by commas; only events with a hit."""
    ends = breakends(events, key).select(key, "side", "chrom", "pos")
    spans = blacklist.where("end_pos > start_pos").select("chrom", "start_pos", "end_pos", F.coalesce("reason", F.lit("")).alias("reason")).distinct()
    hits = nearest_join(ends, spans, ["chrom"], [key, "side"], "pos", "start_pos", "end_pos", within, within * 4)
    return hits.groupBy(key).agg(F.concat_ws(",", F.array_sort(F.collect_set("reason"))).alias("blacklist"))


def nearby_count(ends: DataFrame, positions: DataFrame, keys: Sequence[str], around: int = 500) -> DataFrame:
    """(keys, n): positions within ``around`` of each end; ends with none have no row."""
    spans = ends.select(*keys, "chrom", (F.col("pos") - around).alias("_a"), (F.col("pos") + around).alias("_b"))
    tips = positions.select("chrom", F.col("pos").alias("_c"), F.col("pos").alias("_d"))
    return overlap_join(spans, tips, ["chrom"], ("_a", "_b"), ("_c", "_d"), around * 4).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def nearby_n(sequence: Column) -> Column:
    """Unknown bases in a stretch of the reference."""
    return F.length(sequence) - F.length(F.replace(sequence, F.lit("N"), F.lit("")))


def quality(snvs: Column, unknown: Column, hit: Column, max_snvs: int = 15, max_unknown: int = 50) -> Column:
    """PASS or FAIL; nulls count as nothing found."""
    fails = (F.coalesce(snvs, F.lit(0)) >= max_snvs) | (F.coalesce(unknown, F.lit(0)) > max_unknown) | hit.isNotNull()
    return F.when(fails, "FAIL").otherwise("PASS")


def blacklist_with_unknown(blacklist: Column, unknown: Column, max_unknown: int = 50) -> Column:
    """The reasons with ``,N=<n>`` added where too much is unknown, also to none."""
    return F.when(unknown > max_unknown, F.concat(F.coalesce(blacklist, F.lit("")), F.lit(",N="), unknown.cast("string"))).otherwise(blacklist)


def with_cluster_size(events: DataFrame) -> DataFrame:
    """``events`` with ``n_in_cluster``, the events of the cluster whose ``total`` is known, null without a cluster, and ``distance``, null between chromosomes."""
    sizes = events.where("cluster IS NOT NULL AND cluster <> -1").groupBy("cluster").agg(F.count("total").alias("n_in_cluster"))
    return events.join(sizes, "cluster", "left").withColumn("distance", F.when(F.col("chromx") == F.col("chromy"), F.abs(F.col("x") - F.col("y"))))


def presence(p: Column, shared: Column, total: Column, max_p: float = 1e-6, min_ratio: float = 0.10) -> Column:
    """Whether an event is there: a small p and enough of the barcodes; false where anything is missing."""
    return F.coalesce((p < max_p) & (F.try_divide(shared, total) >= min_ratio), F.lit(False))


def classes(present: DataFrame, samples: Sequence[str], key: str = "event_id", group: str = "dataset") -> DataFrame:
    """(key, classes): a 1 or 0 for each sample, in natural order of the samples; ``present`` has (key, group, present)."""
    one = lambda s: F.max(F.when((F.col(group) == s) & F.col("present"), 1).otherwise(0)).cast("string")
    return present.groupBy(key).agg(F.concat(F.lit(""), *[one(s) for s in sorted(samples, key=natural_key)]).alias("classes"))


def chromosome_pairs(events: DataFrame) -> DataFrame:
    """(chrom_a, chrom_b, n, private, shared_by, complex, complex_frac): events by unordered pair of chromosomes; ``classes`` says in how many samples one is."""
    samples = F.length(F.replace("classes", F.lit("0"), F.lit("")))
    in_complex = F.coalesce(F.col("cluster_size") > 1, F.lit(False))
    per = events.groupBy(F.least("chromx", "chromy").alias("chrom_a"), F.greatest("chromx", "chromy").alias("chrom_b")).agg(F.count(F.lit(1)).alias("n"), F.count_if(samples == 1).alias("private"), F.count_if(samples > 1).alias("shared_by"), F.count_if(in_complex).alias("complex"))
    return per.withColumn("complex_frac", F.round(F.col("complex") / F.col("n"), 6))


def summary(events: DataFrame) -> DataFrame:
    """(what, n, text): counts of events, with their share of all."""
    same = F.col("chromx") == F.col("chromy")
    counts = events.agg(F.count(F.lit(1)).alias("events"), F.count_if(same).alias("intra-chromosomal"), F.count_if(~same).alias("inter-chromosomal"), F.count_if(F.col("assembled")).alias("assembled"), F.count_if(F.upper("quality") == "PASS").alias("passing"))
    names = ("events", "intra-chromosomal", "inter-chromosomal", "assembled", "passing")
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("n"), F.col("events").alias("_all")) for n in names]))
    return counts.select(rows).select("what", "n", percent(F.col("n"), F.col("_all")).alias("text"))


def private_and_shared(events: DataFrame) -> DataFrame:
    """(what, n, of, text): events in one sample and in several, those within a chromosome among each, and how far apart their sides are, in kb.

    ``events`` has chromx, x, chromy, y and ``classes``, a 1 or 0 for each sample.
    """
    samples = F.length(F.replace("classes", F.lit("0"), F.lit("")))
    same, kb = F.col("chromx") == F.col("chromy"), F.abs(F.col("x") - F.col("y")) / 1000
    counts = events.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(samples == 1).alias("private"), F.count_if((samples == 1) & same).alias("private within"), F.count_if(samples > 1).alias("shared"), F.count_if((samples > 1) & same).alias("shared within"),
        *[f(F.when(same, kb)).cast("double").alias(n) for n, f in (("median", F.median), ("least", F.min), ("greatest", F.max))],
    )
    part = lambda what, of: F.struct(F.lit(what).alias("what"), F.col(what).cast("double").alias("n"), F.col(of).alias("of"), percent(F.col(what), F.col(of)).alias("text"))
    far = lambda what: F.struct(F.lit(f"{what} kb").alias("what"), F.col(what).alias("n"), F.lit(None).cast("bigint").alias("of"), F.concat(F.format_number(what, 0), F.lit(" kb")).alias("text"))
    return counts.select(F.inline(F.array(part("private", "all"), part("private within", "private"), part("shared", "all"), part("shared within", "shared"), *map(far, ("median", "least", "greatest")))))


def validation_rates(events: DataFrame, validation: DataFrame, min_shared: int = 10, min_ratio: float = 0.10, key: str = "event_id", group: str = "dataset") -> DataFrame:
    """(what, n, of, text): of the events that some sample has, how many other evidence confirms in any sample, over all and by quality, length and assembly.

    ``validation`` (key, group, shared, total, confirming) has for each event and sample its barcodes and what the other
    evidence counts; ``events`` has key, quality, frag_length_passes, assembled and nearby_snvs.
    """
    per = validation.groupBy(key).agg(F.max(F.coalesce(F.try_divide("shared", "total") > min_ratio, F.lit(False))).alias("_there"), F.max(F.coalesce(F.col("confirming") >= min_shared, F.lit(False))).alias("_seen"))
    rows = events.join(per.where("_there"), key)
    yes = lambda c: F.coalesce(c, F.lit(False))
    passing, simple, assembled = yes(F.upper("quality") == "PASS"), yes(F.col("frag_length_passes")), yes(F.col("assembled"))
    known = {"validated": F.lit(True), "passing": passing, "simple": simple, "assembled": assembled, "assembled or passing": assembled | passing, "assembled and simple": assembled & simple, "assembled or few variants": assembled | yes(F.col("nearby_snvs") < 10)}
    sums = [c for n, w in known.items() for c in (F.count_if(w & F.col("_seen")).alias(n), F.count_if(w).alias(f"of {n}"))]
    counts = rows.agg(*sums)
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("n"), F.col(f"of {n}").alias("of"), percent(F.col(n), F.col(f"of {n}")).alias("text")) for n in known])))


def breakpoints_per_event(events: DataFrame) -> DataFrame:
    """(n_breakpoints, n_events): how many clusters have how many events."""
    return events.where("cluster IS NOT NULL AND cluster <> -1").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_breakpoints")).groupBy("n_breakpoints").agg(F.count(F.lit(1)).alias("n_events"))


def validate(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Full outer join on both breakends and the orientation; either side may be missing."""
    return events.join(evidence, ["chromx", "x", "chromy", "y", "orientation"], "full_outer")
