from fragloom.operators import readclouds as rc

READ = "read_id bigint, chrom string, bc string, pos bigint, ref_end bigint, mapq int, is_duplicate boolean, hap int"


def reads(spark, rows):
    return spark.createDataFrame([(i, "c", b, p, p + 10, q, False, h) for i, (b, p, q, h) in enumerate(rows)], READ)


def test_gap_start_and_trailing_rules(spark):
    rows = [("a", 0, 20, 1), ("a", 50, 60, None), ("a", 100, 45, 2), ("a", 160, 20, 1), ("a", 1000, 45, 1), ("b", 0, 60, 0)]
    got = sorted(map(tuple, rc.read_clouds(reads(spark, rows), 100).select("bc", "start_pos", "end_pos", "num_reads", "hap").collect()))
    # the first read may not start a cloud, the last may not end one, and the far one has no read of 60
    # and the haplotype is that of the read at 50, which has none
    assert got == [("a", 50, 110, 2, None), ("b", 0, 10, 1, 0)]


def test_reads_of_low_quality_between_count_for_the_end(spark):
    def clouds(rows, **kw):
        df = spark.createDataFrame([(i, "c", b, p, e, q, False, h) for i, (b, p, e, q, h) in enumerate(rows)], READ)
        return sorted(map(tuple, rc.read_clouds(df, 100, **kw).select("bc", "start_pos", "end_pos", "num_reads", "obs_len", "hap").collect()))

    rows = [("a", 0, 100, 60, None), ("a", 50, 900, 20, 1), ("a", 350, 450, 60, 1), ("a", 500, 5_000, 10, 1)]
    rows += [("b", 0, 9_000, 20, 1), ("b", 60, 100, 60, 2)]
    want = [("a", 0, 900, 3, 900, None), ("b", 60, 100, 1, 40, 2)]
    assert clouds(rows) == want and clouds(rows, shard_bits=6) == want and clouds(rows, shard_bits=4) == want


def test_clouds_against_brute_force(spark):
    import random

    r = random.Random(8)
    rows = [(r.choice("ab"), p, p + r.choice([10, 40, 300]), r.choice([20, 20, 30, 45, 60]), r.choice([None, 0, 1])) for p in sorted(r.sample(range(20_000), 400))]
    want = []
    for bc in "ab":
        open_, before = [], None
        for row in [x for x in rows if x[0] == bc] + [None]:
            if row is None or (before and row[1] - before[2] > 60):
                own = open_
                while own and own[0][3] <= 30:
                    own = own[1:]
                while own and own[-1][3] < 30:
                    own = own[:-1]
                if own and max(x[3] for x in open_) >= 60:
                    want.append((bc, own[0][1], max(x[2] for x in own), len(own), own[0][4]))
                open_ = []
            if row:
                open_.append(row)
                before = row
    df = spark.createDataFrame([(i, "c", b, p, e, q, False, h) for i, (b, p, e, q, h) in enumerate(rows)], READ)
    for bits in (5, 9, 20):
        assert sorted(map(tuple, rc.read_clouds(df, 60, shard_bits=bits).select("bc", "start_pos", "end_pos", "num_reads", "hap").collect()), key=repr) == sorted(want, key=repr)


def test_numbers_do_not_depend_on_how_barcodes_look(spark):
    names = [f"AAAACCCC{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "bc string").repartition(7)
    assert {r.bc: r.id for r in rc.barcode_ids(df).collect()} == {n: i for i, n in enumerate(names)}
    t = spark.createDataFrame([(n, 1) for n in names], "bc string, num_reads bigint")
    assert sorted(r.bc for r in rc.good_barcodes(t).collect()) == names[:449]


def test_shards_make_no_difference(spark):
    import random

    r = random.Random(0)
    rows = [(r.choice("ab"), r.randint(0, 5000), 60, 1) for _ in range(300)]
    one = rc.number_clouds(reads(spark, rows), ["chrom", "bc"], 30, shard_bits=30)
    many = rc.number_clouds(reads(spark, rows), ["chrom", "bc"], 30, shard_bits=6)
    key = lambda df: sorted((x.read_id, x.cloud, x.place) for x in df.collect())
    assert key(one) == key(many)


def test_good_barcodes_leave_out_the_one_that_crosses(spark):
    t = lambda *n: spark.createDataFrame([(f"b{i}", x) for i, x in enumerate(n)], "bc string, num_reads bigint")
    assert [r.bc for r in rc.good_barcodes(t(80, 10, 10)).collect()] == ["b0"]
    assert rc.good_barcodes(t(95, 5)).count() == 0
    assert sorted(r.bc for r in rc.good_barcodes(t(*[1] * 20)).collect()) == sorted(f"b{i}" for i in range(20))[:17]
    assert rc.good_barcodes(t()).count() == 0


def test_strict_reads_filter(spark):
    f = spark.createDataFrame([("c", 0, 9, 1), ("c", 0, 9, 2)], "chrom string, start_pos bigint, end_pos bigint, num_reads bigint")
    assert [r.num_reads for r in rc.scan_fragments(f, "c", 0, 5).collect()] == [2]
    assert rc.scan_fragments(f, "c", 0, 5, min_reads_per_frag=0).count() == 2
    assert rc.scan_fragments(f, "none").count() == 0
