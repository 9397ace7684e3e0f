"""Queries on genotypes, their export, datasets' summaries and raw reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom.functions import text as tx
from fragloom.functions.conventions import barcode, measurement, with_chromosome
from fragloom.operators import demux as dx
from fragloom.operators import evidence as ev
from fragloom.operators import genotype as ge
from fragloom.operators import qc
from fragloom.operators import support as su
from fragloom.plans import graphs
from fragloom.plans import variants as va
from fragloom.plans.problems import FRAGMENTS_SQL
from fragloom.plans.reads import _READS, reads
from fragloom.plans.tables import fragments, genotypes, table, tips
from fragloom.sources import vcf

LOCUS = 100_000


def _frags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments(spark, sf_dir, "dataset", "chrom", "start_pos", "end_pos", "bc", "hap")


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes(spark, sf_dir).withColumnRenamed("geno_id", "event_id")


def length_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = ge.length_bands(ge.background_lengths(_frags(spark, sf_dir), table(spark, sf_dir, "chroms"), LOCUS, 3))
    return bands.select("dataset", *[F.round(c, 4).alias(c) for c in bands.columns if c != "dataset"])


def length_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, e = _frags(spark, sf_dir), va.events(spark, sf_dir)
    bands = ge.length_bands(ge.background_lengths(f, table(spark, sf_dir, "chroms"), LOCUS, 3))
    out = ge.length_test(ge.joined_lengths(e, f), bands)
    return out.select("event_id", "dataset", F.round("lengths_50", 4).alias("lengths_50"), F.round("lengths_90", 4).alias("lengths_90"), "passes")


def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ge.length_filter(length_genotypes(spark, sf_dir))


def _blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_chromosome(table(spark, sf_dir, "blacklist"), table(spark, sf_dir, "chroms"), "chrom").withColumn("reason", F.lower("reason"))


def blacklist_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ge.blacklist_hits(va.events(spark, sf_dir), _blacklist(spark, sf_dir))


def event_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PASS or FAIL of every event by its neighbourhood; breakends of other events stand for unknown bases."""
    e = va.events(spark, sf_dir)
    ends = su.breakends(e)
    crowd = ge.nearby_count(ends, ends.select("chrom", "pos").distinct(), ["event_id", "side"]).groupBy("event_id").agg(F.max("n").alias("n_near"))
    snvs = _called(spark, sf_dir).select("event_id", "nearby_snvs")
    rows = e.select("event_id").join(snvs, "event_id").join(crowd, "event_id", "left").join(blacklist_nearest(spark, sf_dir), "event_id", "left")
    return rows.select("event_id", F.coalesce("n_near", F.lit(0)).alias("n_near"), ge.quality(F.col("nearby_snvs"), F.col("n_near"), F.col("blacklist"), max_unknown=3).alias("verdict"), ge.blacklist_with_unknown(F.col("blacklist"), F.col("n_near"), 3).alias("reasons"))


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ge.with_cluster_size(_called(spark, sf_dir)).select("event_id", "n_in_cluster", "distance")


def _present(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = su.quantify(va.events(spark, sf_dir), _frags(spark, sf_dir))
    return q.select("event_id", "dataset", ge.presence(F.col("p_fisher"), F.col("shared"), F.col("total")).alias("present"))


def event_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _present(spark, sf_dir)


def _samples(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r.dataset for r in table(spark, sf_dir, "genotypes").select("dataset").distinct().collect()]


def event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ge.classes(_present(spark, sf_dir), _samples(spark, sf_dir))


def chromosome_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by pair of chromosomes, private or shared by the datasets in which they are present."""
    e = va.events(spark, sf_dir).join(event_classes(spark, sf_dir), "event_id", "left").withColumn("classes", F.coalesce("classes", F.lit("")))
    return ge.chromosome_pairs(e.join(cluster_sizes(spark, sf_dir).select("event_id", F.col("n_in_cluster").alias("cluster_size")), "event_id"))


def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ge.summary(_called(spark, sf_dir))


def breakpoints_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ge.breakpoints_per_event(_called(spark, sf_dir))


def private_and_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in one dataset and in several, by the datasets in which they are present."""
    e = va.events(spark, sf_dir).join(event_classes(spark, sf_dir), "event_id", "left").withColumn("classes", F.coalesce("classes", F.lit("")))
    return ge.private_and_shared(e)


def validation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events fragments confirm, whose barcodes are taken from a wider range for that."""
    e = va.events(spark, sf_dir)
    both = tips(spark, sf_dir).confirmed(e, su.breakends(e), -500, 5_000, 20_000)
    called = _called(spark, sf_dir).select("event_id", "quality", "frag_length_passes", "assembled", "nearby_snvs")
    return ge.validation_rates(called, both, min_shared=5)


def background_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments across the loci of each dataset, every 5 Mb, or every 100 kb where that gives fewer than two."""
    loci = ge.background_or_denser(_frags(spark, sf_dir), table(spark, sf_dir, "chroms"), 5_000_000, LOCUS, 3)
    return loci.groupBy("dataset", "chrom", "locus").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("longest"))


def index_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _, samples = _raw_pairs(spark, sf_dir)
    return dx.index_shares(pairs, samples).withColumn("share", F.round("share", 6))


def resampled_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws from every dataset's lengths: how many, and whether all are its lengths."""
    own = _lengths(spark, sf_dir).select("dataset", "len").distinct().withColumn("known", F.lit(1))
    drawn = qc.resampled(_lengths(spark, sf_dir))
    return drawn.join(own, ["dataset", "len"], "left").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_draws"), F.count_distinct("draw").alias("n_different"), F.count("known").alias("n_known"))


def _on_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events on a reference: every document is a chromosome, its letters other than ACGT unknown, and the event of its number lies on it."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").cast("string").alias("chrom"), F.regexp_replace(F.upper("text"), "(?s)[^ACGT]", "N").alias("letters"))
    d = d.withColumn("length", F.length("letters")).groupBy("chrom").agg(F.max(F.struct("length", "letters")).alias("_d")).select("chrom", "_d.*")
    e = va.events(spark, sf_dir).withColumn("chrom", F.col("event_id").cast("string")).join(d.select("chrom", "length"), "chrom")
    e = e.select("event_id", "dataset", F.col("chrom").alias("chromx"), (F.col("x") % F.col("length")).alias("x"), F.col("chrom").alias("chromy"), (F.col("y") % F.col("length")).alias("y"), "orientation")
    bins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(length - 1) div 1000"))).alias("bin")
    reference = d.select("chrom", "letters", bins).select("chrom", "bin", F.substr("letters", (F.col("bin") * 1_000 + 1).cast("int"), F.lit(1_000)).alias("seq"))
    return e, reference


def unknown_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.nearby_unknown(*_on_documents(spark, sf_dir), size=1_000)


def nearby_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants around the events on documents, in reads of 40 letters every 200, in turn of two samples: every third differs, every fifth is a duplicate."""
    e, reference = _on_documents(spark, sf_dir)
    whole = reference.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "seq"))), lambda p: p["seq"]), "").alias("letters"))
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(length(letters) - 40) div 200"))).alias("k")
    rows = whole.where("length(letters) >= 40").select("chrom", "letters", k).withColumn("seq", F.substr("letters", (F.col("k") * 200 + 1).cast("int"), F.lit(40)))
    seq = F.when(F.col("k") % 3 == 0, F.translate("seq", "ACGT", "CGTA")).otherwise(F.col("seq"))
    match = F.array(F.struct(F.lit(40).cast("bigint").alias("len"), F.lit("M").alias("op")))
    reads_ = rows.select(F.when(F.col("k") % 2 == 0, "a").otherwise("b").alias("dataset"), "chrom", (F.col("k") * 200).alias("pos"), F.when(F.col("k") % 5 == 0, 1024).otherwise(0).alias("flag"), match.alias("cigar"), seq.alias("seq"))
    variants = ev.variant_positions(ev.pileup(reads_, ["dataset"]), reference, size=1_000, by=["dataset"])
    return ev.nearby_variants(e, variants)


def reference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PASS or FAIL of every event by its variants, the unknown bases around it and the blacklist."""
    e, reference = _on_documents(spark, sf_dir)
    rows = ev.nearby_unknown(e, reference, size=1_000).join(_called(spark, sf_dir).select("event_id", "nearby_snvs"), "event_id").join(blacklist_nearest(spark, sf_dir), "event_id", "left")
    n = F.col("nearby_n")
    return rows.select("event_id", "nearby_n", ge.quality(F.col("nearby_snvs"), n, F.col("blacklist"), max_unknown=2_000).alias("verdict"), ge.blacklist_with_unknown(F.col("blacklist"), n, 2_000).alias("reasons"))


def reference_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.with_reference_base(*_on_documents(spark, sf_dir), size=1_000).select("event_id", "ref_x", "ref_y")


def vcf_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one column for each dataset: its barcodes, lengths, p and haplotypes."""
    e, own = va.events(spark, sf_dir), tips(spark, sf_dir)
    q = own.quantify(e, su.breakends(e), -500, 5_000, quantiles=(0.5, 0.9)).withColumn("p_resampling", F.round(F.log10(F.when(F.col("p_fisher") > 0, F.col("p_fisher"))), 2).cast("decimal(10,2)"))
    evidence = q.withColumns({c: F.round(F.round(c, 4)).cast("bigint") for c in ("lengths_50", "lengths_90")})
    samples = sorted(_samples(spark, sf_dir))
    fields = vcf.sample_columns(evidence, samples)
    none = ":".join(["0", *["."] * 9])
    called = _called(spark, sf_dir).join(fields, "event_id", "left")
    return vcf.records(called, [F.coalesce(f"s{i}", F.lit(none)) for i in range(len(samples))])


def validated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events called as breakpoints in the first and in the other datasets, side by side."""
    e = va.events(spark, sf_dir)
    first = table(spark, sf_dir, "genotypes").agg(F.min("dataset")).first()[0] or ""
    part = lambda rows, name: rows.groupBy("chromx", "x", "chromy", "y", "orientation").agg(F.count(F.lit(1)).alias(name))
    return ge.validate(part(e.where(F.col("dataset") == first), "n_first"), part(e.where(F.col("dataset") != first), "n_others"))


def vcf_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return vcf.records(_called(spark, sf_dir), vcf.sample_field(F.col("shared"), F.col("total"), *[nothing] * 7))


def vcf_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.header(table(spark, sf_dir, "chroms"), ["all"])


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments(spark, sf_dir, "dataset", "obs_len").withColumn("len", measurement(F.col("obs_len"))).where("len IS NOT NULL")


def fragment_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = qc.length_distribution(_lengths(spark, sf_dir))
    return d.select("dataset", "n", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), *[F.round(F.element_at("q", p // 5 + 1), 3).alias(f"q{p}") for p in range(0, 101, 5)])


def fragment_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.n50(_lengths(spark, sf_dir))


def outlier_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each dataset's lengths."""
    return qc.trim_outliers(_lengths(spark, sf_dir).select("dataset", "len"), ["dataset"], "len").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("longest"))


def length_at_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length that nine in ten fragments of a dataset don't exceed."""
    counts = _lengths(spark, sf_dir).groupBy("dataset", F.col("len").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return qc.size_at_share(counts, ["dataset"])


def physical_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.physical_depth(_frags(spark, sf_dir), table(spark, sf_dir, "chroms"), LOCUS)


def coverage_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.coverage_track(reads(spark, sf_dir).where("NOT is_duplicate AND chrom IS NOT NULL"), ["chrom"], 5_000)


def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.report(qc.length_distribution(_lengths(spark, sf_dir)))


def modal_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent orientation of the events by dataset, the left breakend first."""
    e = va.events(spark, sf_dir)
    return qc.modal_orientation(e, ["dataset"], F.substring("orientation", 1, 1) == "-", F.substring("orientation", 2, 1) == "-", F.col("x") > F.col("y"))


def _raw_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fragments as raw pairs: the barcode leads the first read, the dataset is the sample's index; a barcode seen twice is known, and the last dataset's index is not."""
    f = table(spark, sf_dir, "fragments").where("bc IS NOT NULL AND frag_id IS NOT NULL").select("frag_id", "dataset", F.upper(F.trim("bc")).alias("raw")).distinct()
    seq = F.concat("raw", F.lit("ACGTN"))
    pairs = f.select(F.concat(F.lit("r"), "frag_id").alias("read_name"), F.col("dataset").alias("sample_bc"), seq.alias("seq1"), F.translate(seq, "ACGTN-0123456789,", "IIIIIIIIIIIIIIIII").alias("qual1"), tx.revcomp(seq).alias("seq2"), seq.alias("qual2"))
    known = table(spark, sf_dir, "fragments").select(barcode(F.col("bc")).alias("bc")).where("bc IS NOT NULL").groupBy("bc").count().where("count > 1").select("bc")
    last = table(spark, sf_dir, "fragments").agg(F.max("dataset")).first()[0] or ""
    samples = table(spark, sf_dir, "fragments").where(F.col("dataset") != last).select(F.col("dataset").alias("bc"), "sample").distinct()
    return pairs, known, samples


def demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dx.demultiplex(*_raw_pairs(spark, sf_dir)).select("read_name", "sample", "bc", "seq1", "seq2")


def demux_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dx.demux_counts(*_raw_pairs(spark, sf_dir))


def breakend_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every breakend with its label, and what the label says."""
    ends = su.breakends(va.events(spark, sf_dir))
    label = tx.breakend_label(F.col("chrom"), F.col("pos"), F.col("orientation"))
    return ends.withColumn("label", label).withColumn("_b", tx.breakend_from_label(F.col("label"))).select("event_id", "side", "label", F.col("_b.chrom").alias("chrom"), F.col("_b.pos").alias("pos"))


QUERIES = {
    q.__name__: q
    for q in (
        length_bands, length_genotypes, length_filter, blacklist_nearest, event_quality, cluster_sizes, event_presence, event_classes, chromosome_pairs, event_summary, breakpoints_per_event, private_and_shared, validation_rates, background_loci, index_shares, resampled_lengths, unknown_bases, nearby_variants, reference_quality, reference_bases, vcf_samples, validated_events, vcf_records, vcf_header,
        fragment_quantiles, fragment_n50, outlier_trim, length_at_share, physical_depth, coverage_track, dataset_report, modal_orientation, demux, demux_counts, breakend_labels,
    )
}

_EV = f"{graphs._EVENTS}, e AS (SELECT * RENAME (geno_id AS event_id) FROM ev WHERE y IS NOT NULL AND chromy IS NOT NULL)"
_LEN = f"WITH {FRAGMENTS_SQL}, lens AS (SELECT dataset, obs_len AS len FROM frags WHERE obs_len >= 0 AND obs_len < 500000000)"
_BAND = f"""loci AS (SELECT dataset, f.chrom, unnest(range(start_pos // {LOCUS} + 1, (end_pos - 1) // {LOCUS} + 1)) * {LOCUS} AS locus, end_pos - start_pos AS len FROM frags f WHERE end_pos > start_pos),
bg AS (SELECT l.dataset, chrom, locus, count(*) AS n, quantile_cont(len, [0.2, 0.5, 0.8]) AS q FROM loci l JOIN chroms USING (chrom) WHERE locus < length GROUP BY ALL HAVING count(*) >= 3),
lim AS (SELECT dataset, quantile_cont(n, [0.025, 0.975]) AS bn, quantile_cont(q[2], [0.025, 0.975]) AS bm FROM bg GROUP BY dataset), kept AS (SELECT bg.* FROM bg JOIN lim USING (dataset) WHERE n > bn[1] AND n < bn[2] AND q[2] > bm[1] AND q[2] < bm[2]),
bands AS (SELECT dataset, quantile_cont(q[1], [0.025, 0.975]) AS b20, quantile_cont(q[2], [0.025, 0.975]) AS b50, quantile_cont(q[3], [0.025, 0.975]) AS b80 FROM kept GROUP BY dataset)"""
_TESTED = f"""{va._NEAR.replace('hap FROM sides', "hap, CASE WHEN o = '+' THEN pos - start_pos ELSE end_pos - pos END AS part FROM sides")}, {_BAND}, ends AS (SELECT DISTINCT event_id, dataset, bc, side, frag_id, part FROM near),
merged AS (SELECT event_id, dataset, a.part + b.part AS len FROM ends a JOIN ends b USING (event_id, dataset, bc) WHERE a.side = 'x' AND b.side = 'y' AND a.frag_id <> b.frag_id),
per AS (SELECT event_id, dataset, count(*) AS n, quantile_cont(len, [0.2, 0.5, 0.8, 0.9]) AS q FROM merged GROUP BY ALL),
tested AS (SELECT event_id, dataset, round(q[2], 4) AS lengths_50, round(q[4], 4) AS lengths_90, CASE WHEN n >= 5 THEN q[1] > b20[1] * 0.95 AND q[1] < b20[2] * 1.05 AND q[2] > b50[1] AND q[2] < b50[2] AND q[3] > b80[1] * 0.95 AND q[3] < b80[2] * 1.05 END AS passes FROM per LEFT JOIN bands USING (dataset))"""
_HITS = f"""{_EV}, ends AS (SELECT event_id, 'x' AS side, chromx AS chrom, x AS pos FROM e UNION ALL SELECT event_id, 'y', chromy, y FROM e), bl AS (SELECT DISTINCT coalesce(name, chrom) AS chrom, start_pos AS s, end_pos AS t, coalesce(lower(reason), '') AS reason FROM blacklist LEFT JOIN names ON spelling = chrom WHERE end_pos > start_pos),
d AS (SELECT event_id, side, reason, CASE WHEN pos < s THEN s - pos WHEN pos >= t THEN pos - t + 1 ELSE 0 END AS dist FROM ends JOIN bl USING (chrom)), r AS (SELECT *, rank() OVER (PARTITION BY event_id, side ORDER BY dist) AS k FROM d WHERE dist < 10000),
hits AS (SELECT event_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS blacklist FROM r WHERE k = 1 GROUP BY event_id)"""
_PRESENT = f"{va._QUANTIFY}, present AS (SELECT event_id, dataset, p < 1e-6 AND shared / total >= 0.1 AS present FROM quantified)"
_CLASSES = f"""{_PRESENT}, sets AS (SELECT DISTINCT dataset FROM genotypes), classes AS (SELECT event_id, string_agg(CASE WHEN hit THEN '1' ELSE '0' END, '' ORDER BY dataset) AS classes FROM
  (SELECT i.event_id, s.dataset, coalesce(bool_or(p.present), false) AS hit FROM (SELECT DISTINCT event_id FROM present) i CROSS JOIN sets s LEFT JOIN present p ON p.event_id = i.event_id AND p.dataset = s.dataset GROUP BY ALL) GROUP BY event_id)"""
_RAW = """f AS (SELECT DISTINCT frag_id, dataset, upper(trim(bc, ' ')) AS raw FROM fragments WHERE bc IS NOT NULL AND frag_id IS NOT NULL), known AS (SELECT bc FROM spelled WHERE NOT regexp_matches(bc, '^N*$') GROUP BY bc HAVING count(*) > 1),
samples AS (SELECT DISTINCT dataset, sample FROM fragments WHERE dataset <> (SELECT max(dataset) FROM fragments))"""
SQL = {
    "chromosome_pairs": f"""{_CLASSES}, ev AS (SELECT geno_id AS event_id, coalesce(nx.name, chromx) AS cx, coalesce(ny.name, chromy) AS cy, cluster FROM genotypes LEFT JOIN names nx ON nx.spelling = chromx LEFT JOIN names ny ON ny.spelling = chromy WHERE y IS NOT NULL AND chromy IS NOT NULL),
sizes AS (SELECT cluster, count(total) AS size FROM genotypes WHERE cluster <> -1 GROUP BY cluster), rows AS (SELECT least(cx, cy) AS chrom_a, greatest(cx, cy) AS chrom_b, length(replace(coalesce(classes, ''), '0', '')) AS k, coalesce(size > 1, false) AS many FROM ev LEFT JOIN classes USING (event_id) LEFT JOIN sizes USING (cluster))
SELECT chrom_a, chrom_b, count(*) AS n, count(*) FILTER (k = 1) AS private, count(*) FILTER (k > 1) AS shared_by, count(*) FILTER (many) AS complex, round(count(*) FILTER (many) / count(*), 6) AS complex_frac FROM rows GROUP BY ALL""",
    "dataset_report": f"""{_LEN}, d AS (SELECT dataset, count(*) AS n, avg(len) AS m, quantile_cont(len, [0.25, 0.5, 0.75]) AS q FROM lens GROUP BY dataset)
SELECT dataset, format('{{:,}} fragments; 25/50/75 %: {{:,}} {{:,}} {{:,}} ; mean {{:,}}.{{}}', n, CAST(round_even(q[1], 0) AS BIGINT), CAST(round_even(q[2], 0) AS BIGINT), CAST(round_even(q[3], 0) AS BIGINT), CAST(floor(round_even(m, 1)) AS BIGINT), CAST(round(round_even(m, 1) * 10) AS BIGINT) % 10) AS line FROM d""",
    "vcf_header": """SELECT k - 1 AS n, line FROM (SELECT unnest(range(1, 6)) AS k, unnest(['##fileformat=VCFv4.3', '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">', '##INFO=<ID=MATEID,Number=1,Type=String,Description="ID of mate breakend">',
  '##INFO=<ID=ASSEMBLED,Number=0,Type=Flag,Description="Breakpoint was assembled">', '##INFO=<ID=EVENT,Number=1,Type=String,Description="Cluster of the breakpoint">']) AS line)
UNION ALL SELECT idx + 1000, '##contig=<ID=' || chrom || ',length=' || length || '>' FROM chroms UNION ALL SELECT 1000000000, concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 'all')""",
    "length_bands": f"WITH {FRAGMENTS_SQL}, {_BAND} SELECT dataset, round(b20[1], 4) AS low_20, round(b20[2], 4) AS high_20, round(b50[1], 4) AS low_50, round(b50[2], 4) AS high_50, round(b80[1], 4) AS low_80, round(b80[2], 4) AS high_80 FROM bands",
    "length_genotypes": f"{_TESTED} SELECT * FROM tested",
    "length_filter": f"{_TESTED} SELECT event_id, coalesce(bool_or(passes), false) AS frag_length_passes FROM tested GROUP BY event_id",
    "blacklist_nearest": f"{_HITS} SELECT * FROM hits",
    "event_quality": f"""{_HITS}, pts AS (SELECT DISTINCT chrom, pos FROM ends), crowd AS (SELECT event_id, max(n) AS n FROM (SELECT event_id, side, count(*) AS n FROM ends a JOIN pts b ON a.chrom = b.chrom AND b.pos BETWEEN a.pos - 500 AND a.pos + 500 GROUP BY ALL) GROUP BY event_id)
SELECT e.event_id, coalesce(n, 0) AS n_near, CASE WHEN coalesce(nearby_snvs, 0) >= 15 OR coalesce(n, 0) > 3 OR h.blacklist IS NOT NULL THEN 'FAIL' ELSE 'PASS' END AS verdict, CASE WHEN n > 3 THEN coalesce(h.blacklist, '') || ',N=' || n ELSE h.blacklist END AS reasons FROM e LEFT JOIN crowd USING (event_id) LEFT JOIN hits h USING (event_id)""",
    "cluster_sizes": f"{graphs._EVENTS}, sizes AS (SELECT cluster, count(total) AS n FROM genotypes WHERE cluster <> -1 GROUP BY cluster) SELECT geno_id AS event_id, n AS n_in_cluster, CASE WHEN chromx = chromy THEN abs(x - y) END AS distance FROM ev LEFT JOIN sizes USING (cluster)",
    "event_presence": f"{_PRESENT} SELECT * FROM present",
    "event_classes": f"{_CLASSES} SELECT * FROM classes",
    "event_summary": f"""{graphs._EVENTS}, c AS (SELECT count(*) AS total, count(*) FILTER (chromx = chromy) AS i, count(*) FILTER (chromx <> chromy) AS j, count(*) FILTER (assembled) AS a, count(*) FILTER (upper(quality) = 'PASS') AS p FROM ev), r AS (SELECT total, unnest(['events', 'intra-chromosomal', 'inter-chromosomal', 'assembled', 'passing']) AS what, unnest([total, i, j, a, p]) AS n FROM c)
SELECT what, n, CASE WHEN total > 0 THEN printf('%d (%.1f%%)', n, n * 100.0 / total) ELSE printf('%d', n) END AS text FROM r""",
    "breakpoints_per_event": "SELECT n_breakpoints, count(*) AS n_events FROM (SELECT cluster, count(*) AS n_breakpoints FROM genotypes WHERE cluster <> -1 GROUP BY cluster) GROUP BY n_breakpoints",
    "validated_events": f"""{_EV}, a AS (SELECT chromx, x, chromy, y, orientation, count(*) AS n_first FROM e WHERE dataset = (SELECT min(dataset) FROM genotypes) GROUP BY ALL), b AS (SELECT chromx, x, chromy, y, orientation, count(*) AS n_others FROM e WHERE dataset <> (SELECT min(dataset) FROM genotypes) GROUP BY ALL)
SELECT * FROM a FULL JOIN b USING (chromx, x, chromy, y, orientation)""",
    "vcf_records": f"""{_EV}, m AS (SELECT *, unnest([0, 1]) AS m FROM e), s AS (SELECT *, CASE m WHEN 0 THEN chromx ELSE chromy END AS c, CASE m WHEN 0 THEN x ELSE y END AS p1, CASE m WHEN 0 THEN chromy ELSE chromx END || ':' || (CASE m WHEN 0 THEN y ELSE x END + 1) AS other, CASE m WHEN 0 THEN orientation ELSE reverse(orientation) END AS o FROM m)
SELECT event_id || ':' || m AS id, concat_ws(chr(9), c, p1 + 1, event_id || ':' || m, 'N', CASE o WHEN '+-' THEN 'N[' || other || '[' WHEN '++' THEN 'N]' || other || ']' WHEN '-+' THEN ']' || other || ']N' WHEN '--' THEN '[' || other || '[N' END, '0',
  CASE WHEN contains(coalesce(blacklist, ''), 'N=') OR nearby_snvs >= 15 OR NOT frag_length_passes THEN concat_ws(';', CASE WHEN contains(blacklist, 'N=') THEN 'ASSEMBLYGAP' END, CASE WHEN nearby_snvs >= 15 THEN 'NEARBYSNVS' END, CASE WHEN NOT frag_length_passes THEN 'NOLONGFRAGS' END) ELSE 'PASS' END,
  concat_ws(';', 'SVTYPE=BND', 'MATEID=' || event_id || ':' || (1 - m), CASE WHEN assembled THEN 'ASSEMBLED' END, 'EVENT=' || cluster), '{vcf.FORMAT}', concat_ws(':', CASE WHEN shared > 5 THEN '1' ELSE '0' END, coalesce(CAST(shared AS VARCHAR), '.'), coalesce(CAST(total AS VARCHAR), '.'), '.', '.', '.', '.', '.', '.', '.')) AS line FROM s""",
    "fragment_quantiles": f"{_LEN} SELECT dataset, count(*) AS n, round(avg(len), 3) AS mean, round(stddev_pop(len), 3) AS std, {', '.join(f'round(quantile_cont(len, {p / 100}), 3) AS q{p}' for p in range(0, 101, 5))} FROM lens GROUP BY dataset",
    "fragment_n50": f"{_LEN}, r AS (SELECT dataset, len, sum(len) OVER (PARTITION BY dataset ORDER BY len ROWS UNBOUNDED PRECEDING) AS upto, sum(len) OVER (PARTITION BY dataset) AS total FROM lens) SELECT dataset, min(len) FILTER (upto >= total * 0.25) AS n25, min(len) FILTER (upto >= total * 0.5) AS n50, min(len) FILTER (upto >= total * 0.75) AS n75 FROM r GROUP BY dataset",
    "outlier_trim": f"{_LEN}, m AS (SELECT dataset, median(len) AS med FROM lens GROUP BY dataset), d AS (SELECT dataset, median(abs(len - med)) AS mad FROM lens JOIN m USING (dataset) GROUP BY dataset) SELECT dataset, count(*) AS n, max(len) AS longest FROM lens JOIN m USING (dataset) JOIN d USING (dataset) WHERE mad = 0 OR len - med < mad * 10 GROUP BY dataset",
    "length_at_share": f"{_LEN}, r AS (SELECT dataset, len, count(*) OVER (PARTITION BY dataset ORDER BY len RANGE UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY dataset) AS total FROM lens) SELECT dataset, min(len) AS size FROM r WHERE upto >= total * 0.9 GROUP BY dataset",
    "physical_depth": f"""WITH {FRAGMENTS_SQL}, loci AS (SELECT chrom, unnest(range(0, (length - 1) // {LOCUS} + 1)) AS locus FROM chroms), hits AS (SELECT dataset, chrom, locus, count(*) AS n FROM (SELECT dataset, chrom, unnest(range((start_pos + {LOCUS} - 1) // {LOCUS}, (end_pos - 1) // {LOCUS} + 1)) AS locus FROM frags WHERE end_pos > start_pos) GROUP BY ALL)
SELECT d.dataset, CAST(median(coalesce(n, 0)) AS DOUBLE) AS depth, median(coalesce(n, 0)) * 0.2 AS min_support FROM (SELECT DISTINCT dataset FROM hits) d CROSS JOIN loci LEFT JOIN hits USING (dataset, chrom, locus) GROUP BY d.dataset""",
    "coverage_track": f"""WITH {_READS}, c AS (SELECT chrom, pos // 5000 AS w, count(*) AS n FROM reads GROUP BY ALL), near AS (SELECT a.chrom, a.w, a.n, median(b.n) AS s, count(*) AS k FROM c a JOIN c b ON a.chrom = b.chrom AND b.w BETWEEN a.w - 2 AND a.w + 2 GROUP BY ALL) SELECT chrom, w, n, CASE WHEN k = 5 THEN s END AS smooth FROM near""",
    "modal_orientation": f"""{_EV}, o AS (SELECT dataset, CASE WHEN x > y THEN reverse(orientation) ELSE orientation END AS orientation, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, orientation) AS k FROM o) SELECT dataset, orientation, n FROM r WHERE k = 1""",
    "demux": f"WITH {FRAGMENTS_SQL}, {_RAW} SELECT 'r' || frag_id || ' BX:Z:' || left(raw, 16) AS read_name, sample, left(raw, 16) AS bc, substr(raw || 'ACGTN', 17) AS seq1, reverse(translate(raw || 'ACGTN', 'ATCGatcg', 'TAGCtagc')) AS seq2 FROM f JOIN known ON bc = left(raw || 'ACGTN', 16) JOIN samples USING (dataset)",
    "demux_counts": f"WITH {FRAGMENTS_SQL}, {_RAW} SELECT count(*) AS total, count(*) FILTER (bc IS NOT NULL AND s.dataset IS NOT NULL) AS good, count(*) FILTER (bc IS NULL) AS bad_gem, count(*) FILTER (bc IS NOT NULL AND s.dataset IS NULL) AS bad_sample FROM f LEFT JOIN known ON bc = left(raw || 'ACGTN', 16) LEFT JOIN (SELECT DISTINCT dataset FROM samples) s ON s.dataset = f.dataset",
    "breakend_labels": f"""{_EV}, ends AS (SELECT event_id, 'x' AS side, chromx AS chrom, x AS pos, substr(orientation, 1, 1) AS o FROM e UNION ALL SELECT event_id, 'y', chromy, y, substr(orientation, 2, 1) FROM e) SELECT event_id, side, chrom || ':' || format('{{:,}}', pos) || o AS label, chrom, pos FROM ends""",
}

_WIDE = va._SUPPORT.format(near=-500, far=20_000) + va._QUANTIFY[len(va._NEAR) :].split(",\nfx AS")[0]
_ON_DOCS = f"""{_EV}, docs AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, regexp_replace(upper(text), '[^ACGT]', 'N', 'gs') AS letters FROM documents WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC) = 1),
placed AS (SELECT event_id, letters, x % length(letters) AS x, y % length(letters) AS y FROM e JOIN docs ON chrom = CAST(event_id AS VARCHAR))"""
_COUNT_N = "length({w}) - length(replace({w}, 'N', ''))"
_AROUND = "substr(letters, CAST(greatest({s} - 5000, 0) + 1 AS BIGINT), CAST({s} + 5000 - greatest({s} - 5000, 0) AS BIGINT))"
SQL |= {
    "private_and_shared": f"""{_CLASSES}, ev AS (SELECT geno_id AS event_id, coalesce(nx.name, chromx) AS cx, x, coalesce(ny.name, chromy) AS cy, y FROM genotypes LEFT JOIN names nx ON nx.spelling = chromx LEFT JOIN names ny ON ny.spelling = chromy WHERE y IS NOT NULL AND chromy IS NOT NULL),
rows AS (SELECT cx = cy AS same, abs(x - y) / 1000 AS kb, length(replace(coalesce(classes, ''), '0', '')) AS k FROM ev LEFT JOIN classes USING (event_id)),
c AS (SELECT count(*) AS a, count(*) FILTER (k = 1) AS p, count(*) FILTER (k = 1 AND same) AS pw, count(*) FILTER (k > 1) AS s, count(*) FILTER (k > 1 AND same) AS sw, median(kb) FILTER (same) AS m, min(kb) FILTER (same) AS l, max(kb) FILTER (same) AS g FROM rows),
parts AS (SELECT unnest(['private', 'private within', 'shared', 'shared within']) AS what, unnest([p, pw, s, sw]) AS n, unnest([a, p, a, s]) AS total FROM c), far AS (SELECT unnest(['median kb', 'least kb', 'greatest kb']) AS what, unnest([m, l, g]) AS n FROM c)
SELECT what, CAST(n AS DOUBLE) AS n, total AS "of", CASE WHEN total > 0 THEN printf('%d (%.1f%%)', n, n * 100.0 / total) ELSE printf('%d', n) END AS text FROM parts UNION ALL SELECT what, n, NULL, format('{{:,}} kb', CAST(round_even(n, 0) AS BIGINT)) FROM far""",
    "validation_rates": f"""{va._QUANTIFY}, rows AS (SELECT q.event_id, shared / total > 0.1 AS there, w.n >= 5 AS seen FROM quantified q LEFT JOIN confirming w USING (event_id, dataset)), per AS (SELECT event_id, bool_or(there) AS there, coalesce(bool_or(seen), false) AS seen FROM rows GROUP BY event_id),
g AS (SELECT seen, coalesce(upper(quality) = 'PASS', false) AS q, coalesce(frag_length_passes, false) AS l, coalesce(assembled, false) AS a, coalesce(nearby_snvs < 10, false) AS v FROM per JOIN genotypes ON geno_id = event_id WHERE there),
long AS (SELECT seen, unnest(['validated', 'passing', 'simple', 'assembled', 'assembled or passing', 'assembled and simple', 'assembled or few variants']) AS what, unnest([true, q, l, a, a OR q, a AND l, a OR v]) AS yes FROM g), c AS (SELECT what, count(*) FILTER (yes AND seen) AS n, count(*) FILTER (yes) AS total FROM long GROUP BY what)
SELECT what, n, total AS "of", CASE WHEN total > 0 THEN printf('%d (%.1f%%)', n, n * 100.0 / total) ELSE printf('%d', n) END AS text FROM c""",
    "background_loci": f"""WITH {FRAGMENTS_SQL}, steps AS (SELECT unnest([5000000, {LOCUS}]) AS step), hits AS (SELECT dataset, f.chrom, step, unnest(range(start_pos // step + 1, (end_pos - 1) // step + 1)) * step AS locus, end_pos - start_pos AS len FROM frags f, steps WHERE end_pos > start_pos),
loci AS (SELECT dataset, h.chrom, step, locus, count(*) AS n, max(len) AS longest FROM hits h JOIN chroms USING (chrom) WHERE locus < length GROUP BY ALL HAVING count(*) >= 3), many AS (SELECT dataset FROM loci WHERE step = 5000000 GROUP BY dataset HAVING count(*) >= 2)
SELECT dataset, chrom, locus, n, longest FROM loci WHERE CASE WHEN dataset IN (SELECT dataset FROM many) THEN step = 5000000 ELSE step = {LOCUS} END""",
    "index_shares": f"WITH {FRAGMENTS_SQL}, {_RAW}, c AS (SELECT dataset AS sample_bc, count(*) AS n FROM f WHERE NOT contains(dataset, 'N') GROUP BY dataset) SELECT sample_bc, n, round(n / (SELECT sum(n) FROM c), 6) AS share, sample_bc IN (SELECT dataset FROM samples) AS known, sample_bc NOT IN (SELECT dataset FROM samples) AND n > (SELECT sum(n) FROM c) / (SELECT count(DISTINCT dataset) FROM samples) * 0.1 AS warn FROM c",
    "resampled_lengths": f"{_LEN} SELECT dataset, 10000 AS n_draws, 10000 AS n_different, 10000 AS n_known FROM lens GROUP BY dataset",
    "unknown_bases": f"{_ON_DOCS} SELECT event_id, greatest({', '.join(_COUNT_N.format(w=_AROUND.format(s=s)) for s in 'xy')}) AS nearby_n FROM placed",
    "reference_bases": f"{_ON_DOCS} SELECT event_id, substr(letters, CAST(x + 1 AS BIGINT), 1) AS ref_x, substr(letters, CAST(y + 1 AS BIGINT), 1) AS ref_y FROM placed",
}
SQL["nearby_variants"] = f"""{_ON_DOCS}, sides AS (SELECT event_id, letters, 'x' AS side, x AS pos FROM placed UNION ALL SELECT event_id, letters, 'y', y FROM placed),
hits AS (SELECT event_id, side, q // 200 AS k FROM (SELECT *, unnest(range(CAST(greatest(pos - 500, 0) AS BIGINT), CAST(least(pos + 500, length(letters)) AS BIGINT))) AS q FROM sides) WHERE q % 200 < 40 AND q - q % 200 + 40 <= length(letters) AND (q // 200) % 3 = 0 AND (q // 200) % 5 <> 0 AND substr(letters, q + 1, 1) <> 'N'),
per AS (SELECT event_id, side, k % 2 AS sample, count(*) AS n FROM hits GROUP BY ALL), most AS (SELECT event_id, side, max(n) AS n FROM per GROUP BY ALL) SELECT p.event_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS nearby_snvs FROM placed p LEFT JOIN most USING (event_id) GROUP BY p.event_id"""
SQL["reference_quality"] = f"""WITH u AS ({SQL["unknown_bases"]}), h AS ({SQL["blacklist_nearest"]}) SELECT u.event_id, nearby_n, CASE WHEN coalesce(nearby_snvs, 0) >= 15 OR nearby_n > 2000 OR h.blacklist IS NOT NULL THEN 'FAIL' ELSE 'PASS' END AS verdict, CASE WHEN nearby_n > 2000 THEN coalesce(h.blacklist, '') || ',N=' || nearby_n ELSE h.blacklist END AS reasons
FROM u JOIN genotypes ON geno_id = u.event_id LEFT JOIN h ON h.event_id = u.event_id"""
SQL["validation_rates"] = SQL["validation_rates"].replace(", rows AS (SELECT q.event_id", f", confirming AS (SELECT event_id, dataset, shared AS n FROM ({_WIDE} SELECT event_id, dataset, shared FROM counts)), rows AS (SELECT q.event_id", 1)
_FIELDS = "concat_ws(':', CASE WHEN q.shared > 5 THEN '1' ELSE '0' END, q.shared, q.total, coalesce(CAST(CAST(round(t.lengths_50) AS BIGINT) AS VARCHAR), '.'), coalesce(CAST(CAST(round(t.lengths_90) AS BIGINT) AS VARCHAR), '.'), coalesce(CAST(CAST(round(log10(CASE WHEN q.p > 0 THEN q.p END), 2) AS DECIMAL(10, 2)) AS VARCHAR), '.'), x_hap0, x_hap1, y_hap0, y_hap1)"
SQL["vcf_samples"] = f"""WITH lines AS ({SQL["vcf_records"]}), fields AS (SELECT event_id, dataset, {_FIELDS} AS f FROM ({va._QUANTIFY} SELECT * FROM quantified) q LEFT JOIN ({SQL["length_genotypes"]}) t USING (event_id, dataset)), sets AS (SELECT DISTINCT dataset FROM genotypes),
every AS (SELECT l.id, string_agg(coalesce(f.f, '0:.:.:.:.:.:.:.:.:.'), chr(9) ORDER BY s.dataset) AS columns FROM lines l CROSS JOIN sets s LEFT JOIN fields f ON CAST(f.event_id AS VARCHAR) = split_part(l.id, ':', 1) AND f.dataset = s.dataset GROUP BY l.id)
SELECT id, array_to_string(string_split(line, chr(9))[1:9], chr(9)) || chr(9) || columns AS line FROM lines JOIN every USING (id)"""
SQL["event_characteristics"] = f"SELECT event_id, supporting, overlapping, fraction, coalesce(frag_length_passes, false) AS lengths_match FROM ({va.SQL['pair_characteristics']}) LEFT JOIN ({SQL['length_filter']}) USING (event_id)"
