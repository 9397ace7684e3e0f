import random

import pytest
from pyspark.sql import functions as F

from fragloom.operators import candidates, demux, evidence, genotype, graph, qc, windows
from fragloom.operators import readclouds as rc
from fragloom.session import Scratch
from fragloom.sources import vcf


def _sample(spark):
    r = random.Random(2)
    seq = "".join(r.choices("ACGTN", k=2_500))
    return seq, spark.createDataFrame([("c", b, seq[b * 1_000 : (b + 1) * 1_000].lower()) for b in range(3)], "chrom string, bin bigint, seq string")


def test_stretches_of_the_reference_go_over_its_pieces(spark):
    seq, ref = _sample(spark)
    spans = [(1, "c", -5, 3), (2, "c", 990, 2_010), (3, "c", 2_490, 9_000), (4, "c", 5, 5), (5, "d", 0, 9), (6, "c", 8_000, 9_000), (7, None, 0, 9)]
    df = spark.createDataFrame(spans, "k int, chrom string, start bigint, end bigint").withColumn("seq", F.lit("clash")).drop("seq")
    got = {r.k: r.seq for r in evidence.reference_stretches(df, ref, ["k"], 1_000).collect()}
    assert got == {1: seq[:3], 2: seq[990:2_010], 3: seq[2_490:]}


def test_unknown_bases_and_own_bases(spark):
    seq, ref = _sample(spark)
    e = spark.createDataFrame([(1, "c", 100, "c", 1_500, "+-"), (2, "c", 2_499, None, None, "+-"), (3, "d", 1, "c", 9_999, "--")], "event_id int, chromx string, x bigint, chromy string, y bigint, orientation string")
    near = lambda p: seq[max(0, p - 200) : p + 200].count("N")
    assert {r.event_id: r.nearby_n for r in evidence.nearby_unknown(e, ref, 200, size=1_000).collect()} == {1: max(near(100), near(1_500)), 2: near(2_499), 3: 0}
    own = {r.event_id: (r.ref_x, r.ref_y) for r in vcf.with_reference_base(e, ref, size=1_000).collect()}
    assert own == {1: (seq[100], seq[1_500]), 2: (seq[2_499], None), 3: (None, None)}


def test_variants_near_both_sides(spark):
    e = spark.createDataFrame([(1, "c", 600, "c", 5_000, "+-"), (2, "c", 100, None, None, "+-"), (3, "q", 1, "q", 2, "++")], "event_id int, chromx string, x bigint, chromy string, y bigint, orientation string")
    rows = [("a", "c", p) for p in (99, 100, 1_099, 1_100)] + [("b", "c", p) for p in (100, 101, 102)] + [("a", "c", 5_000), ("a", "c", 5_000)]
    v = spark.createDataFrame(rows, "dataset string, chrom string, pos bigint")
    # from 100 to 1,099 sample b has three and a two; beside y there is one
    assert {r.event_id: r.nearby_snvs for r in evidence.nearby_variants(e, v).collect()} == {1: 4, 2: 3, 3: 0}


def test_pileup_leaves_out_reads_by_flag(spark):
    rows = [("d", "c", 0, f, [(2, "M")], "AC") for f in (0, 16, 4, 256, 512, 1024, None)]
    df = spark.createDataFrame(rows, "dataset string, chrom string, pos bigint, flag int, cigar array<struct<len:bigint,op:string>>, seq string")
    assert {(r.dataset, r.pos, r.base): r.n for r in evidence.pileup(df, ["dataset"]).collect()} == {("d", 0, "A"): 3, ("d", 1, "C"): 3}


def test_sampling_reads_and_samples(spark):
    rows = [(i, "c", "b", f) for i, f in enumerate((0, 64, 128, 256, 2048, 4, 1024, None))] + [(90, "c", None, 0), (91, None, "b", 0)]
    df = spark.createDataFrame(rows, "read_id int, chrom string, bc string, flag int")
    assert {r.read_id for r in rc.sampling_reads(df).collect()} == {0, 1, 6, 7}
    big = spark.range(5_000).select(F.col("id"), (F.col("id") % 3 == 0).cast("string").alias("g"))
    one = rc.sampled(big, 40, ["g"], "id")
    assert one.groupBy("g").count().select("count").distinct().collect()[0][0] == 40
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, rc.sampled(big.repartition(9), 40, ["g"], "id").collect()))
    assert rc.sampled(big.limit(0), 40, ["g"], "id").count() == 0


def test_fragments_by_chromosome_are_pruned(spark, tmp_path):
    rows = [(f"c{i % 3}", i * 1_000, i * 1_000 + 5_000, f"b{i}", i % 4) for i in range(900)] + [("c1", 7_000, 7_500, None, 9)]
    df = spark.createDataFrame(rows, "chrom string, start_pos bigint, end_pos bigint, bc string, num_reads bigint")
    rc.write_fragments(df, f"{tmp_path}/f", 1 << 16)
    got = rc.read_fragments(spark, f"{tmp_path}/f", "c1", 5_000, 60_000)
    assert sorted((r.start_pos, r.num_reads) for r in got.collect()) == sorted((s, n) for c, s, e, _, n in rows if c == "c1" and n > 1 and s < 60_000 and e > 5_000)
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = rc.read_fragments(spark, f"{tmp_path}/f", "c1", 5_000, 60_000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert "PartitionFilters: [isnotnull(chrom" in plan and "LessThan(start_pos,60000)" in plan


def test_margins_fall_off_at_the_breakpoint(spark):
    # along x the counts are 5 5 5 0 0, along y 0 5 5 5 5
    cells = [(1, bx, by, 5) for bx in range(3) for by in range(1, 5)]
    m = spark.createDataFrame(cells, "region_id int, bx bigint, `by` bigint, n bigint")
    r = spark.createDataFrame([(1, 1_000, 1_050, 0, 50), (2, 0, 50, 0, 50)], "region_id int, startx bigint, endx bigint, starty bigint, endy bigint")
    assert [tuple(x) for x in candidates.marginal_breakpoints(m, r, size=10).collect()] == [(1, 1_030, 0, "+-")]


def test_events_on_the_reference(spark):
    e = spark.createDataFrame([(1, "a", "b"), (2, "a", "z"), (3, None, "a")], "event_id int, chromx string, chromy string")
    c = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "chrom string, idx int")
    assert [r.event_id for r in graph.on_reference(e, c).collect()] == [1]


def test_distance_of_regions_and_clustered_events(spark):
    f = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 11, None)], "len bigint")
    assert windows.region_distance(f).first().distance == pytest.approx(5.4)
    assert windows.region_distance(f.limit(0)).first().distance is None
    e = spark.createDataFrame([(1, "c", 0, "c", 3_000, "+-"), (2, "c", 9_000, None, None, "+-")], "event_id int, chromx string, x bigint, chromy string, y bigint, orientation string").withColumn("assembled", F.lit(False))
    got = graph.with_clustered(e, graph.precluster(graph.event_positions(e)))
    assert {(r.event_id, r.x, r.y, r.original_x, r.original_y) for r in got.collect()} == {(1, 1_500, 1_500, 0, 3_000), (2, 9_000, None, 9_000, None)}


def test_draws_from_a_distribution(spark):
    df = spark.createDataFrame([("d", v) for v in [1] * 900 + [5] * 100] + [("e", 7)], "dataset string, len bigint")
    got = qc.resampled(df, 2_000)
    n = {(r.dataset, r.len): r["count"] for r in got.groupBy("dataset", "len").count().collect()}
    assert n["e", 7] == 2_000 and 1_700 < n["d", 1] < 1_900 and n["d", 1] + n["d", 5] == 2_000
    assert qc.resampled(df.limit(0), 10).count() == 0


def test_shares_of_indices(spark):
    pairs = spark.createDataFrame([("A",)] * 60 + [("C",)] * 38 + [("T",)] * 2 + [("NA",)], "sample_bc string")
    samples = spark.createDataFrame([("A", "s1"), ("G", "s2")], "bc string, sample string")
    got = {r.sample_bc: (r.n, r.share, r.known, r.warn) for r in demux.index_shares(pairs, samples).collect()}
    assert got == {"A": (60, 0.6, True, False), "C": (38, 0.38, False, True), "T": (2, 0.02, False, False)}
    assert demux.index_shares(pairs.limit(0), samples).count() == 0


def test_denser_background_where_loci_are_few(spark):
    rows = [("many", "c", 0, 500_000)] * 5 + [("few", "c", 0, 120_000)] * 5
    f = spark.createDataFrame(rows, "dataset string, chrom string, start_pos bigint, end_pos bigint")
    c = spark.createDataFrame([("c", 1_000_000)], "chrom string, length bigint")
    got = {(r.dataset, r.locus) for r in genotype.background_or_denser(f, c, 100_000, 10_000).collect()}
    assert got == {("many", i * 100_000) for i in range(1, 5)} | {("few", i * 10_000) for i in range(1, 12)}


def test_validation_counts(spark):
    e = spark.createDataFrame([(1, "PASS", True, True, 0), (2, "FAIL", None, False, 20), (3, "PASS", True, True, 0)], "event_id int, quality string, frag_length_passes boolean, assembled boolean, nearby_snvs bigint")
    v = spark.createDataFrame([(1, "d", 5, 10, 12), (1, "e", 0, 0, None), (2, "d", 5, 10, 3), (3, "d", 0, 10, 50)], "event_id int, dataset string, shared bigint, total bigint, confirming bigint")
    got = {r.what: (r.n, r.of, r.text) for r in genotype.validation_rates(e, v).collect()}
    assert got["validated"] == (1, 2, "1 (50.0%)") and got["passing"] == (1, 1, "1 (100.0%)") and got["assembled or few variants"] == (1, 1, "1 (100.0%)")


def test_tables_are_dropped_and_measured(spark):
    import os

    s = Scratch(spark, "t")
    t, seen = s.measured(spark.range(7), F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    path = t._scratch_path
    assert seen == {"n": 7, "most": 6} and t.count() == 7 and os.path.exists(path.removeprefix("file:"))
    s.drop(t, None, spark.range(3))
    assert not os.path.exists(path.removeprefix("file:"))
    s.forget()
    assert not os.path.exists(s.root.removeprefix("file:"))
