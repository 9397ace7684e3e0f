"""Events as VCF: two mate records for each breakpoint, as lines that Spark writes as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragloom.operators.evidence import reference_stretches
from fragloom.operators.support import breakends

FORMAT = "GT:BS:BT:F50:F90:PR:H1x:H2x:H1y:H2y"


def alt(ref: Column, chrom: Column, pos: Column, orientation: Column) -> Column:
    """The other end, at 1-based ``pos``, in the notation of breakends."""
    at = F.concat(chrom, F.lit(":"), pos.cast("string"))
    return (
        F.when(orientation == "+-", F.concat(ref, F.lit("["), at, F.lit("[")))
        .when(orientation == "++", F.concat(ref, F.lit("]"), at, F.lit("]")))
        .when(orientation == "-+", F.concat(F.lit("]"), at, F.lit("]"), ref))
        .when(orientation == "--", F.concat(F.lit("["), at, F.lit("["), ref))
    )


def filters(blacklist: Column, snvs: Column, length_passes: Column, max_snvs: int = 15) -> Column:
    names = F.array_compact(F.array(F.when(F.contains(blacklist, F.lit("N=")), "ASSEMBLYGAP"), F.when(snvs >= max_snvs, "NEARBYSNVS"), F.when(~length_passes, "NOLONGFRAGS")))
    return F.when(F.size(names) > 0, F.concat_ws(";", names)).otherwise("PASS")


def info(mate: Column, assembled: Column, cluster: Column) -> Column:
    parts = F.array_compact(F.array(F.lit("SVTYPE=BND"), F.concat(F.lit("MATEID="), mate), F.when(assembled, "ASSEMBLED"), F.concat(F.lit("EVENT="), cluster.cast("string"))))
    return F.concat_ws(";", parts)


def sample_field(shared: Column, *rest: Column) -> Column:
    """Genotype (1 with more than 5 shared barcodes) and the other values, ``.`` where one is missing."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    genotype = F.when(F.coalesce(shared, F.lit(0)) > 5, "1").otherwise("0")
    return F.concat_ws(":", genotype, text(shared), *[text(c) for c in rest])


def header(chroms: DataFrame, samples: Sequence[str]) -> DataFrame:
    """(n, line): the header's lines in order, contigs in the order of the reference."""
    fixed = ["##fileformat=VCFv4.3", '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">', '##INFO=<ID=MATEID,Number=1,Type=String,Description="ID of mate breakend">', '##INFO=<ID=ASSEMBLED,Number=0,Type=Flag,Description="Breakpoint was assembled">', '##INFO=<ID=EVENT,Number=1,Type=String,Description="Cluster of the breakpoint">']
    spark = chroms.sparkSession
    top = spark.createDataFrame([(i, line) for i, line in enumerate(fixed)], "n bigint, line string")
    contigs = chroms.select((F.col("idx") + 1_000).cast("bigint").alias("n"), F.format_string("##contig=<ID=%s,length=%d>", "chrom", "length").alias("line"))
    last = spark.createDataFrame([(10**9, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]))], "n bigint, line string")
    return top.unionByName(contigs).unionByName(last)


def records(events: DataFrame, sample: Column | Sequence[Column], ref: str = "N") -> DataFrame:
    """(id, line): both mates of every event with both sides; positions are written from 1 on, quality is 0.

    ``events`` has event_id, chromx, x, chromy, y, orientation, cluster, assembled, blacklist, nearby_snvs and
    frag_length_passes; where it has ref_x and ref_y these are the mates' own bases, and ``ref`` stands for a missing one. The
    second mate turns the orientation, but not the haplotypes in ``sample``, one field or one for each sample.
    """
    sample = F.concat_ws("\t", *sample) if isinstance(sample, (list, tuple)) else sample
    own_base = lambda s: F.coalesce(F.col(f"ref_{s}"), F.lit(ref)) if f"ref_{s}" in events.columns else F.lit(ref)
    both = events.where("y IS NOT NULL AND chromy IS NOT NULL AND x IS NOT NULL AND chromx IS NOT NULL").withColumn("_s", sample)
    o = F.col("orientation")
    side = lambda m, a, b, turn: F.struct(F.lit(m).alias("m"), F.col(f"chrom{a}").alias("chrom"), F.col(a).alias("pos"), F.col(f"chrom{b}").alias("mate_chrom"), F.col(b).alias("mate_pos"), turn.alias("o"), own_base(a).alias("ref"))
    mates = both.withColumn("_m", F.explode(F.array(side(0, "x", "y", o), side(1, "y", "x", F.reverse(o)))))
    name = lambda m: F.concat(F.col("event_id").cast("string"), F.lit(":"), m.cast("string"))
    own, mate = name(F.col("_m.m")), name(1 - F.col("_m.m"))
    fields = [
        F.col("_m.chrom"), (F.col("_m.pos") + 1).cast("string"), own, F.col("_m.ref"), alt(F.col("_m.ref"), F.col("_m.mate_chrom"), F.col("_m.mate_pos") + 1, F.col("_m.o")), F.lit("0"),
        filters(F.col("blacklist"), F.col("nearby_snvs"), F.col("frag_length_passes")), info(mate, F.col("assembled"), F.col("cluster")), F.lit(FORMAT), F.col("_s"),
    ]
    return mates.select(own.alias("id"), F.concat_ws("\t", *fields).alias("line"))


def with_reference_base(events: DataFrame, reference: DataFrame, key: str = "event_id", size: int = 100_000) -> DataFrame:
    """``events`` with ``ref_x`` and ``ref_y``, the reference's bases at both breakends in upper case; null beyond the reference's ends."""
    at = breakends(events, key).select(key, "side", "chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    bases = reference_stretches(at, reference, [key, "side"], size).groupBy(key).agg(F.max(F.when(F.col("side") == "x", F.col("seq"))).alias("ref_x"), F.max(F.when(F.col("side") == "y", F.col("seq"))).alias("ref_y"))
    return events.join(bases, key, "left")


def sample_columns(evidence: DataFrame, samples: Sequence[str], key: str = "event_id", group: str = "dataset") -> DataFrame:
    """(key, s0, s1, ...): the field of every sample, in the order of ``samples``; an event without evidence in a sample has the genotype 0 and no values there.

    ``evidence`` has one row for each event and sample: (key, group, shared, total, lengths_50, lengths_90, p_resampling,
    x_hap0, x_hap1, y_hap0, y_hap1).
    """
    field = sample_field(F.col("shared"), *[F.col(c) for c in ("total", "lengths_50", "lengths_90", "p_resampling", "x_hap0", "x_hap1", "y_hap0", "y_hap1")])
    nothing = ":".join(["0", *["."] * (FORMAT.count(":"))])
    per = evidence.select(key, group, field.alias("_f")).groupBy(key)
    return per.agg(*[F.coalesce(F.max(F.when(F.col(group) == s, F.col("_f"))), F.lit(nothing)).alias(f"s{i}") for i, s in enumerate(samples)])


def write_vcf(head: DataFrame, body: DataFrame, path: str) -> None:
    """``path``/header and ``path``/records as text; records stay in as many files as Spark makes of them."""
    head.orderBy("n").coalesce(1).select("line").write.mode("overwrite").text(f"{path}/header")
    body.select("line").write.mode("overwrite").text(f"{path}/records")
