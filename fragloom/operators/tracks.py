"""What lies around an event: fragment tracks, pairs at its breakpoint, and the reads of its barcodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragloom.operators.rangejoin import overlap_join

BIN = 100_000


def event_sites(events: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, dataset, site, chrom, start, end, orientation): both ends of every event as sites 0 and 1."""
    end = lambda s, i: F.struct(F.lit(i).alias("site"), F.col(f"chrom{s}").alias("chrom"), F.col(s).alias("start"), F.col(s).alias("end"), F.substring("orientation", i + 1, 1).alias("orientation"))
    return events.select(key, "dataset", F.inline(F.array(end("x", 0), end("y", 1)))).where("chrom IS NOT NULL AND start IS NOT NULL")


def fragment_tracks(sites: DataFrame, fragments: DataFrame, extend: int = 100_000, near: int = -500, far: int = 5_000, key: str = "event_id") -> DataFrame:
    """(key, site, frag_id, bc, start_pos, end_pos, supporting, track): fragments around the sites of an event whose barcode supports two or more of them.

    A site is a breakend (start = end, with an orientation), or two facing ones (no orientation), numbered along the event. A
    fragment supports a breakend where it ends (``+``) or starts (``-``) from ``near`` to ``far`` on its side, and a facing
    pair where it lies between the two, give or take -``near``. Barcodes are numbered from 0 by their first supporting site,
    their first fragment there, and name; only these numbers are made per event, over one row for each barcode. Fragments
    without a barcode or usable interval support nothing and are left out; repeated ones come once.
    """
    around = sites.select(key, "dataset", "site", "chrom", "start", "end", "orientation", F.greatest(F.col("start") - extend, F.lit(1)).alias("_a"), (F.col("end") + extend - 1).alias("_b"))
    own = fragments.where("bc IS NOT NULL AND end_pos > start_pos").select("dataset", "chrom", "frag_id", "bc", "start_pos", "end_pos", (F.col("end_pos") - 1).alias("_last")).distinct()
    found = overlap_join(around, own, ["dataset", "chrom"], ("_a", "_b"), ("start_pos", "_last"), BIN)
    at = (
        F.when(F.col("orientation") == "+", (F.col("start") - F.col("end_pos")).between(near, far))
        .when(F.col("orientation") == "-", (F.col("start_pos") - F.col("start")).between(near, far))
        .otherwise((F.col("start_pos") > F.col("start") + near) & (F.col("end_pos") < F.col("end") - near))
    )
    found = found.select(key, "site", "frag_id", "bc", "start_pos", "end_pos", at.alias("supporting"))
    first = F.min(F.when(F.col("supporting"), F.struct("site", "start_pos", "end_pos"))).alias("first")
    sided = found.groupBy(key, "bc", "site").agg(first).where("first IS NOT NULL")
    good = sided.groupBy(key, "bc").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).where("n > 1")
    numbered = good.withColumn("track", F.row_number().over(Window.partitionBy(key).orderBy("first", "bc")).cast("bigint") - 1)
    return found.join(numbered.select(key, "bc", "track"), [key, "bc"]).select(key, "site", "frag_id", "bc", "start_pos", "end_pos", "supporting", "track")


def _to_breakend(orientation: Column, pos: str, start: str, end: str) -> Column:
    """How far before a breakend the fragment ends, or after it starts."""
    return F.when(orientation == "+", F.col(pos) - F.col(end)).when(orientation == "-", F.col(start) - F.col(pos))


def pair_characteristics(events: DataFrame, pairs: DataFrame, near: int = -500, far: int = 5_000, around: int = 12_000, key: str = "event_id") -> DataFrame:
    """(key, supporting, overlapping, fraction): pairs of fragments that end at both breakends of an event, and those that lie within ``around`` of both.

    ``pairs`` has (key, start_x, end_x, start_y, end_y), as ``support.fragment_pairs`` makes them; both limits belong to the
    range. An event without pairs has zeros; one without its y side, or with another orientation than + and -, supports none.
    """
    e = events.select(key, F.col("x").alias("_x"), F.col("y").alias("_y"), F.substring("orientation", 1, 1).alias("_ox"), F.substring("orientation", 2, 1).alias("_oy"))
    both = e.join(pairs.select(key, "start_x", "end_x", "start_y", "end_y"), key, "left")
    at = [_to_breakend(F.col(f"_o{s}"), f"_{s}", f"start_{s}", f"end_{s}").between(near, far) for s in "xy"]
    over = [(F.col(f"start_{s}") <= F.col(f"_{s}") + around) & (F.col(f"end_{s}") >= F.col(f"_{s}") - around) for s in "xy"]
    counts = both.groupBy(key).agg(F.count_if(at[0] & at[1]).alias("supporting"), F.count_if(over[0] & over[1]).alias("overlapping"))
    return counts.withColumn("fraction", F.when(F.col("overlapping") > 0, F.col("supporting") / F.col("overlapping")).otherwise(F.lit(0.0)))


def read_counts(regions: DataFrame, reads: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, n): reads over each half-open region (key, chrom, start, end), whatever their flags; 0 where there is none.

    ``key`` identifies a region; a read that covers no base counts as one. Unmapped reads are over no region.
    """
    spans = regions.select(*key, F.col("chrom").alias("_c"), F.col("start").alias("_a"), (F.col("end") - 1).alias("_b"))
    own = reads.where("chrom IS NOT NULL").select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.greatest(F.col("ref_end") - 1, "pos").alias("_q"))
    hits = overlap_join(spans, own, ["_c"], ("_a", "_b"), ("_p", "_q"), 10_000)
    counts = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return regions.select(*key).distinct().join(counts, list(key), "left").select(*key, F.coalesce("n", F.lit(0)).alias("n"))


def insert_sizes(alignments: DataFrame, by: Sequence[str] = (), max_size: int = 20_000, min_mapq: int = 55) -> DataFrame:
    """(by, size, n): how many first reads of proper pairs on one chromosome have each insert size below ``max_size``.

    ``alignments`` has flag, mapq, chrom, next_chrom and insert_size, as the readers make them. A null in any of them leaves
    a read out.
    """
    proper = (F.col("flag").bitwiseAND(F.lit(1 | 2 | 64)) == (1 | 2 | 64)) & (F.col("flag").bitwiseAND(F.lit(4 | 8)) == 0)
    kept = alignments.where(proper & (F.col("chrom") == F.col("next_chrom")) & (F.col("mapq") >= min_mapq))
    return kept.withColumn("size", F.abs("insert_size")).where(F.col("size") < max_size).groupBy(*by, "size").agg(F.count(F.lit(1)).alias("n"))


def cluster_reads(barcodes: DataFrame, reads: DataFrame) -> DataFrame:
    """(cluster, read_name, read, seq): the reads of every cluster's barcodes; one read may go to several clusters.

    ``barcodes`` (cluster, bc) may repeat rows. ``reads`` has read_name, bc, flag and seq; secondary and supplementary rows,
    which repeat a read, are left out. ``read`` is 0 for the first of a pair and 1 for the second. Barcodes with many reads are
    left to adaptive execution, which splits their rows.
    """
    first = F.when(F.col("flag").bitwiseAND(F.lit(128)) != 0, 1).otherwise(0)
    own = reads.where(F.col("flag").bitwiseAND(F.lit(256 | 2048)) == 0).select("bc", "read_name", first.alias("read"), "seq")
    return barcodes.select("cluster", "bc").distinct().join(own, "bc").select("cluster", "read_name", "read", "seq")


def write_cluster_reads(rows: DataFrame, path: str) -> None:
    """The rows of ``cluster_reads`` as tab-separated text under one folder for each cluster."""
    rows.select("cluster", F.concat_ws("\t", "read_name", F.col("read").cast("string"), "seq").alias("value")).write.mode("overwrite").partitionBy("cluster").text(path)
