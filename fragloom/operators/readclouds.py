"""Read clouds: aligned reads of one barcode that lie close together become one fragment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragloom.session import Scratch

SHARD_BITS = 20


def good_reads(reads: DataFrame) -> DataFrame:
    """Reads with a barcode that are mapped and no duplicates."""
    return reads.where("bc IS NOT NULL AND chrom IS NOT NULL AND NOT is_duplicate")


def haplotype(ps: Column, hp: Column) -> Column:
    """The haplotype, where the phase set is known too."""
    return F.when(ps.isNotNull(), hp)


def sampling_reads(alignments: DataFrame) -> DataFrame:
    """Reads from which distances are taken: mapped first reads with a barcode that are neither secondary nor supplementary, duplicates included.

    ``alignments`` has flag and bc. A null flag counts as 0.
    """
    return alignments.where(F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(F.lit(4 | 128 | 256 | 2048)) == 0).where("bc IS NOT NULL AND chrom IS NOT NULL")


def sampled(df: DataFrame, most: int, by: Sequence[str], *order: str) -> DataFrame:
    """A sample of at most ``most`` rows of each group, the first by a hash of the ``order`` columns, the same in every run.

    A sampling operator, for a look at the data; nothing else here works on a sample. Every task first keeps the ``most`` rows
    of each of 64 parts of a group, so that no group is sorted in one place.
    """
    first = [F.xxhash64(*order), *[F.col(c) for c in order]]
    part = df.withColumn("_part", F.pmod(F.xxhash64(*order, F.lit(1)), F.lit(64)))
    some = part.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*first))).where(F.col("_n") <= most)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*first))).where(F.col("_n") <= most).drop("_n", "_part")


def number_clouds(reads: DataFrame, by: Sequence[str], max_dist: int, order: str = "read_id", shard_bits: int = SHARD_BITS) -> DataFrame:
    """``reads`` with ``cloud`` and ``place``, both counted from 1 within ``by``: a read more than ``max_dist`` after the end of the one before it starts a cloud.

    Reads are numbered in shards of positions first; the shards' totals are added up per key after that, so a barcode with any
    part of all reads is spread over its shards. ``by`` and positions must not be null.
    """
    shard = F.shiftright("pos", shard_bits)
    w = Window.partitionBy(*by, "_shard").orderBy("pos", order)
    local = reads.withColumn("_shard", shard).withColumn("_before", F.lag("ref_end").over(w))
    breaks = F.when(F.col("_before").isNotNull() & (F.col("pos") - F.col("_before") > max_dist), 1).otherwise(0)
    local = local.withColumns({"_cloud": F.sum(breaks).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_place": F.row_number().over(w)})
    at = F.struct("pos", order)
    shards = local.groupBy(*by, "_shard").agg(F.min("pos").alias("first"), F.max_by("ref_end", at).alias("last"), F.max("_cloud").alias("clouds"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy(*by).orderBy("_shard")
    previous = F.lag("last").over(over)
    opens = F.when(previous.isNull() | (F.col("first") - previous > max_dist), 1).otherwise(0)
    shards = shards.withColumn("opens", opens)
    running = over.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    base = F.coalesce(F.sum(F.col("opens") + F.col("clouds")).over(running), zero) + F.col("opens")
    shards = shards.select(*by, "_shard", base.alias("_cloud_base"), F.coalesce(F.sum("n").over(running), zero).alias("_place_base"))
    joined = local.join(shards, [*by, "_shard"])
    return joined.withColumns({"cloud": F.col("_cloud") + F.col("_cloud_base"), "place": F.col("_place") + F.col("_place_base")}).drop("_shard", "_before", "_cloud", "_place", "_cloud_base", "_place_base")


def read_clouds(reads: DataFrame, max_dist: int, by: Sequence[str] = ("chrom", "bc"), start_mapq: int = 30, end_mapq: int = 30, one_mapq: int = 60, shard_bits: int = SHARD_BITS) -> DataFrame:
    """(by, start_pos, end_pos, num_reads, obs_len, hap): the clouds of good reads.

    A cloud starts at its first read with a mapping quality above ``start_mapq``, and reads of less than ``end_mapq`` at its
    end are left out; it needs a read of at least ``one_mapq``. It ends at the greatest end of the reads between, whatever
    their quality. ``hap`` is the haplotype of its first read, null where that has none. A shard of a cloud is brought down to
    one row first, so a barcode with any part of all reads is spread over its shards.
    """
    numbered = number_clouds(good_reads(reads), by, max_dist, shard_bits=shard_bits).withColumn("_shard", F.shiftright("pos", shard_bits))
    opening, closing = F.col("mapq") > start_mapq, F.col("mapq") >= end_mapq
    w = Window.partitionBy(*by, "_shard", "cloud").orderBy("place")
    begun = F.coalesce(F.max(opening).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    goes_on = F.coalesce(F.max(closing).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(False))
    marked = numbered.withColumns({"_begun": begun, "_goes_on": goes_on})
    reach = lambda cond: F.max(F.when(cond, F.col("ref_end")))
    shards = marked.groupBy(*by, "cloud", "_shard").agg(
        F.min(F.when(opening, F.struct("place", "pos", "hap"))).alias("first"),
        F.max(F.when(closing, F.col("place"))).alias("last"),
        F.max("mapq").alias("best"),
        reach(F.lit(True)).alias("all"),
        reach(F.col("_begun")).alias("from_first"),
        reach(F.col("_goes_on")).alias("to_last"),
        reach(F.col("_begun") & F.col("_goes_on")).alias("between"),
    )
    part = F.struct("_shard", F.col("first").isNotNull().alias("opens"), F.col("last").isNotNull().alias("closes"), "all", "from_first", "to_last", "between")
    clouds = shards.groupBy(*by, "cloud").agg(
        F.min("first").alias("_first"), F.max("last").alias("_last"), F.max("best").alias("_best"),
        F.min(F.when(F.col("first").isNotNull(), F.col("_shard"))).alias("_a"), F.max(F.when(F.col("last").isNotNull(), F.col("_shard"))).alias("_b"), F.collect_list(part).alias("_parts"),
    )
    kept = clouds.where((F.col("_best") >= one_mapq) & F.col("_first").isNotNull())

    def own(p: Column) -> Column:
        at_start, at_end = p["_shard"] == F.col("_a"), p["_shard"] == F.col("_b")
        inner = F.when(at_start & at_end, p["between"]).when(at_start, p["from_first"]).when(at_end, p["to_last"]).otherwise(p["all"])
        return F.when((p["_shard"] >= F.col("_a")) & (p["_shard"] <= F.col("_b")), inner)

    ended = kept.select(*by, F.col("_first.pos").alias("start_pos"), F.array_max(F.transform("_parts", own)).alias("end_pos"), (F.col("_last") - F.col("_first.place") + 1).alias("num_reads"), F.col("_first.hap").alias("hap"))
    return ended.select(*by, "start_pos", "end_pos", "num_reads", (F.col("end_pos") - F.col("start_pos")).alias("obs_len"), "hap")


def inter_read_distances(reads: DataFrame, by: Sequence[str] = ("chrom", "bc"), most: int = 60_000, shard_bits: int = SHARD_BITS) -> DataFrame:
    """(by, distance): from each read to the next one of its barcode, where below ``most``, which must be less than a shard.

    A shard's reads meet the next shard's first read through one row per shard.
    """
    rows = good_reads(reads).select(*by, "pos", "read_id").withColumn("_shard", F.shiftright("pos", shard_bits))
    first = rows.groupBy(*by, "_shard").agg(F.min("pos").alias("pos")).select(*by, (F.col("_shard") - 1).alias("_shard"), "pos", F.lit(None).cast("bigint").alias("read_id"))
    w = Window.partitionBy(*by, "_shard").orderBy("pos", F.col("read_id").asc_nulls_last())
    both = rows.unionByName(first).withColumn("distance", F.col("pos") - F.lag("pos").over(w))
    return both.where(F.col("distance") < most).select(*by, "distance")


def clustering_distance(distances: DataFrame, percent: float = 0.99, step: int = 5_000, least: int = 10_000) -> DataFrame:
    """(distance, p99): the percentile rounded up to ``step``, at least ``least``; null without distances."""
    p = distances.agg(F.percentile("distance", F.lit(percent)).alias("p99"))
    return p.select(F.greatest(F.lit(least), F.ceil(F.col("p99") / step) * step).alias("distance"), "p99")


def barcode_totals(fragments: DataFrame, by: Sequence[str] = ("bc",)) -> DataFrame:
    """(by, num_reads): reads of each barcode."""
    return fragments.where("bc IS NOT NULL").groupBy(*by).agg(F.sum(F.coalesce("num_reads", F.lit(0))).alias("num_reads"))


def numbered_by(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``number``, dense from 0 in the order of ``column``: rows are sorted in ranges and counted in them, whatever the values look like."""
    ranged = df.repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id())
    ranged = Scratch(df.sparkSession, "ranges").table(ranged).withColumns({"_part": F.shiftright("_at", 33), "_own": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each range, of which there are as many as tasks
    return ranged.join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part").withColumn("number", F.col("_before") + F.col("_own")).drop("_at", "_part", "_own", "_before")


def good_barcodes(totals: DataFrame, share: float = 0.9) -> DataFrame:
    """(bc, num_reads): the barcodes with most reads that together stay below ``share`` of all; the one that reaches it is out.

    Equal numbers are taken in the order of the barcode. The running sum goes over the distinct numbers of reads, of which
    there are at most the root of twice the reads, and within the one number at which it stops over parts of the barcodes.
    """
    counts = totals.groupBy("num_reads").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("num_reads")).rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum(F.col("num_reads") * F.col("n")).over(down), F.lit(0))
    limit = F.sum(F.col("num_reads") * F.col("n")).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share
    room = F.when(F.col("num_reads") > 0, F.ceil((limit - above) / F.col("num_reads")) - 1).otherwise(F.when(limit > above, F.col("n")).otherwise(0))
    allowed = counts.select("num_reads", "n", room.alias("room")).where("room > 0")
    whole = totals.join(allowed.where("room >= n").select("num_reads"), "num_reads", "left_semi")
    # of one number of reads at most only a part goes in: the first by barcode
    split = numbered_by(totals.join(allowed.where("room < n").select("num_reads", "room"), "num_reads"), "bc").where(F.col("number") < F.col("room"))
    return whole.select("bc", "num_reads").unionByName(split.select("bc", "num_reads"))


def barcode_ids(fragments: DataFrame) -> DataFrame:
    """(bc, id): dense numbers from 0 in the order of the barcode."""
    return numbered_by(fragments.where("bc IS NOT NULL").select("bc").distinct(), "bc").select("bc", F.col("number").alias("id"))


def combine_read_clouds(clouds: Sequence[DataFrame], share: float = 0.9) -> DataFrame:
    """The clouds of all parts that belong to a good barcode."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), clouds)
    return both.join(good_barcodes(barcode_totals(both), share).select("bc"), "bc", "left_semi")


def write_fragments(fragments: DataFrame, path: str, bin_size: int = 1 << 24) -> None:
    """Fragments as files by chromosome, sorted by position in them, so that a scan of a range reads that chromosome's row groups in the range alone.

    The files of a chromosome are stretches of ``bin_size`` positions, so a long or hot chromosome is written by many tasks.
    """
    rows = fragments.withColumn("_bin", F.expr(f"start_pos div {bin_size}"))
    rows.repartition("chrom", "_bin").sortWithinPartitions("chrom", "start_pos", "end_pos", "bc").drop("_bin").write.mode("overwrite").partitionBy("chrom").parquet(path)


def read_fragments(spark: SparkSession, path: str, chrom: str, start: int | None = None, end: int | None = None, min_reads_per_frag: int = 1) -> DataFrame:
    """``scan_fragments`` over files that ``write_fragments`` wrote."""
    return scan_fragments(spark.read.parquet(path), chrom, start, end, min_reads_per_frag)


def scan_fragments(fragments: DataFrame, chrom: str, start: int | None = None, end: int | None = None, min_reads_per_frag: int = 1) -> DataFrame:
    """Fragments that overlap a range and have more than ``min_reads_per_frag`` reads (0: all); an unknown chromosome has none."""
    if start is not None and (start < 0 or end is not None and start >= end):
        raise ValueError("a range needs 0 <= start < end")
    out = fragments.where(F.col("chrom") == chrom)
    if min_reads_per_frag > 0:
        out = out.where(F.col("num_reads") > min_reads_per_frag)
    if end is not None:
        out = out.where(F.col("start_pos") < end)
    return out.where(F.col("end_pos") > start) if start is not None else out
