import numpy as np
from pyspark.sql import functions as F

from fragloom.operators import evidence as ev


def test_signed_rank_normal_form():
    p = ev.signed_rank_less(np.arange(100) / 1000.0, 50.0)
    assert abs(p - 1.95e-18) < 1e-19  # no ties, every draw below
    assert np.isnan(ev.signed_rank_less(np.array([3.0, 3.0]), 3.0))
    assert ev.signed_rank_less(np.array([5.0, 6.0, 7.0, 9.0]), 1.0) > 0.9


def test_draws_follow_the_weights():
    rng = np.random.default_rng(0)
    weights, counts = np.array([1.0, 9.0]), np.array([500, 500])
    drawn = np.array([ev._draw(rng, weights, counts, 100) for _ in range(200)])
    assert (drawn.sum(axis=1) == 100).all()
    assert 7 < drawn[:, 0].mean() < 14  # about one in ten, a little more as the heavy ones run out
    assert (ev._draw(rng, weights, counts, 5000) == counts).all()


def test_resampling_is_seeded_and_one_sided(spark):
    totals = spark.createDataFrame([("d", f"b{i}", 1 + i % 3) for i in range(1000)], "dataset string, bc string, num_reads bigint")
    rows = [(1, "d", 30, 20, 20), (2, "d", 0, 50, 50)]
    q = spark.createDataFrame(rows, "event_id bigint, dataset string, shared bigint, only_x bigint, only_y bigint")
    one = {r.event_id: r.p_resampling for r in ev.resampling_p(q, totals).collect()}
    assert one == {r.event_id: r.p_resampling for r in ev.resampling_p(q, totals).collect()}
    assert one[1] < 1e-15 and one[2] > 0.9


def test_shared_names(spark):
    e = spark.createDataFrame([(1, "c", 1000, "d", 5000, "+-")], "event_id bigint, chromx string, x bigint, chromy string, y bigint, orientation string")
    rows = [("both", "c", 900, 950, True, 60), ("both", "d", 5100, 5150, False, 60), ("x", "c", 990, 1040, True, 60), ("low", "c", 950, 999, True, 10), ("wrong", "c", 950, 999, False, 60), ("far", "c", 100, 150, True, 60)]
    reads = spark.createDataFrame(rows, "read_name string, chrom string, pos bigint, ref_end bigint, is_reverse boolean, mapq int").withColumns({"is_secondary": F.lit(False), "is_supplementary": F.lit(False)})
    assert [tuple(r) for r in ev.shared_read_names(e, reads, 200).collect()] == [(1, 1, 2)]


def test_pileup_and_variants(spark):
    op = "array<struct<len:bigint,op:string>>"
    rows = [("c", 2, [(1, "S"), (2, "M"), (1, "D"), (2, "M")], "TACGG"), ("c", 2, [(2, "M"), (1, "I"), (1, "M")], "ACTA"), (None, 0, [], "A")]
    piled = ev.pileup(spark.createDataFrame(rows, f"chrom string, pos bigint, cigar {op}, seq string"))
    assert {(r.pos, r.base): r.n for r in piled.collect()} == {(2, "A"): 2, (3, "C"): 2, (5, "G"): 1, (6, "G"): 1, (4, "A"): 1}
    ref = spark.createDataFrame([("c", 0, "NNaCTGC")], "chrom string, bin bigint, seq string")
    assert {(r.pos, r.frac) for r in ev.variant_positions(piled, ref).collect()} == {(4, 1.0), (6, 1.0)}


def test_covered_bases(spark):
    f = spark.createDataFrame([(1, "c", "b", 100, 200), (2, "c", "x", 0, 50)], "id bigint, chrom string, bc string, start_pos bigint, end_pos bigint")
    r = spark.createDataFrame([("c", "b", 90, 110), ("c", "b", 105, 120), ("c", "b", 190, 250), ("c", "q", 130, 140)], "chrom string, bc string, pos bigint, ref_end bigint")
    assert [tuple(x) for x in ev.covered_bases(f, r, ["id"]).collect()] == [(1, 30)]


def test_cap_is_stable(spark):
    b = spark.createDataFrame([(e, f"b{i}") for e in (1, 2) for i in range(30)], "event_id bigint, bc string")
    one = ev.cap_barcodes(b, 10)
    assert one.count() == 20 and sorted(map(tuple, one.collect())) == sorted(map(tuple, ev.cap_barcodes(b.repartition(3), 10).collect()))


def test_contig_walk(spark):
    cols = "cluster string, contig string, chrom string, start bigint, end bigint, q_start bigint, q_end bigint, clip_left boolean, clip_right boolean"
    rows = [("k", "t1", "1", 10_000, 11_000, 0, 1000, False, True), ("k", "t1", "2", 50_000, 51_000, 1005, 2005, True, False), ("k", "t2", "2", 54_000, 55_000, 0, 1000, False, True), ("k", "t2", "gl_1", 5, 900, 1001, 1900, True, False)]
    starts = spark.createDataFrame([("k", 1, "1", 10_500), ("none", 2, "1", 1)], "cluster string, start_id bigint, chrom string, pos bigint")
    got = [tuple(r)[3:] for r in ev.contig_walks(starts, spark.createDataFrame(rows, cols)).orderBy("step").collect()]
    # from chromosome 1 over contig t1 to chromosome 2; contig t2 leads to a decoy, where the walk ends
    assert got == [("1", 11_000, "+", "2", 50_000, "-", "t1")]
