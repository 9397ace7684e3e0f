from fragloom.operators import tracks

FRAGS = "dataset string, chrom string, frag_id bigint, bc string, start_pos bigint, end_pos bigint"
SITES = "event_id bigint, dataset string, site int, chrom string, start bigint, end bigint, orientation string"


def test_tracks_of_a_chain(spark):
    sites = [(1, "d", 0, "c", 200_000, 200_000, "+"), (1, "d", 1, "e", 50_000, 60_000, None), (1, "d", 2, "c", 900_000, 900_000, "-")]
    frags = [
        ("d", "c", 1, "a", 150_000, 199_000), ("d", "e", 2, "a", 50_100, 59_000),  # supports sites 0 and 1
        ("d", "c", 3, "b", 100_000, 199_500), ("d", "c", 4, "b", 900_000, 950_000),  # 0 and 2, starts first
        ("d", "c", 5, "once", 150_000, 199_000), ("d", "e", 6, "once", 40_000, 70_000),  # supports one site only
        ("d", "c", 7, "a", 150_000, 250_000), ("d", "c", 7, "a", 150_000, 250_000),  # spans; delivered twice
        ("d", "c", 8, None, 150_000, 199_000), ("d", "c", 9, "a", 199_000, 150_000), ("x", "c", 10, "a", 150_000, 199_000), ("d", "c", 11, "b", None, 5),
    ]
    out = tracks.fragment_tracks(spark.createDataFrame(sites, SITES), spark.createDataFrame(frags, FRAGS)).collect()
    assert sorted((r.site, r.frag_id, r.bc, r.supporting, r.track) for r in out) == [(0, 1, "a", True, 1), (0, 3, "b", True, 0), (0, 7, "a", False, 1), (1, 2, "a", True, 1), (2, 4, "b", True, 0)]
    assert tracks.fragment_tracks(spark.createDataFrame([], SITES), spark.createDataFrame(frags, FRAGS)).count() == 0


def test_pair_characteristics(spark):
    events = spark.createDataFrame([(1, 1000, 9000, "+-"), (2, 1000, 9000, "--"), (3, 5, None, "+.")], "event_id bigint, x bigint, y bigint, orientation string")
    pairs = [(1, 10, 900, 9000, 9900), (1, 10, 1500, 8500, 9900), (1, 10, 1501, 9000, 9900), (1, 10, 900, 40_000, 50_000), (3, 1, 4, 1, 2)]
    out = tracks.pair_characteristics(events, spark.createDataFrame(pairs, "event_id bigint, start_x bigint, end_x bigint, start_y bigint, end_y bigint")).collect()
    assert sorted(map(tuple, out)) == [(1, 2, 3, 2 / 3), (2, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_reads_of_regions_and_clusters(spark, tmp_path):
    reads = spark.createDataFrame([("c", 5, 15), ("c", 19, 30), ("c", 20, 30), ("c", 15, 15), (None, 12, 14)], "chrom string, pos bigint, ref_end bigint")
    regions = spark.createDataFrame([(1, "c", 10, 20), (2, "c", 40, 50), (3, "z", 0, 9)], "id bigint, chrom string, start bigint, end bigint")
    assert sorted(map(tuple, tracks.read_counts(regions, reads, ["id"]).collect())) == [(1, 3), (2, 0), (3, 0)]
    rows = [("r", "a", 65, "AC"), ("r", "a", 129, "GT"), ("r", "a", 65 | 256, "AC"), ("s", "b", 65, "TT"), ("t", None, 65, "TT")]
    b = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "a"), ("k2", "b")], "cluster string, bc string")
    out = tracks.cluster_reads(b, spark.createDataFrame(rows, "read_name string, bc string, flag int, seq string"))
    assert sorted(map(tuple, out.collect())) == [("k1", "r", 0, "AC"), ("k1", "r", 1, "GT"), ("k2", "r", 0, "AC"), ("k2", "r", 1, "GT"), ("k2", "s", 0, "TT")]
    tracks.write_cluster_reads(out, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).where("cluster = 'k2'").collect()) == ["r\t0\tAC", "r\t1\tGT", "s\t0\tTT"]


def test_insert_sizes(spark):
    rows = [(67, 60, "c", "c", -300), (67, 60, "c", "c", 300), (131, 60, "c", "c", 300), (65, 60, "c", "c", 300), (67, 20, "c", "c", 300), (67, 60, "c", "d", 300), (67 | 8, 60, "c", "c", 300), (67, 60, "c", "c", 20_000), (67, None, "c", "c", 9)]
    out = tracks.insert_sizes(spark.createDataFrame(rows, "flag int, mapq int, chrom string, next_chrom string, insert_size bigint"))
    assert [tuple(r) for r in out.collect()] == [(300, 2)]
