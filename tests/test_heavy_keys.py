import random
from collections import defaultdict

from fragloom.operators.heavy_keys import dominant_keys, join_aggregate, key_loads

SCHEMA = "dataset string, bc string, num_reads bigint, rows string"


def _rows(seed, n):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), r.choice(["HOT"] * 6 + ["x", "y", "z", None]), r.choice([0, 1, 5, None]), "clash") for _ in range(n)]


def test_loads_against_brute_force(spark):
    data = _rows(1, 400)
    want = defaultdict(lambda: [0, 0])
    outer = defaultdict(lambda: [0, 0])
    for d, b, n, _ in data:
        if b is not None:
            for at in (want[d, b], outer[d]):
                at[0] += 1
                at[1] += n or 0
    got = {(r.dataset, r.bc): (r.rows, r.sum_num_reads, r.outer_rows, r.outer_sum) for r in key_loads(spark.createDataFrame(data, SCHEMA), ["dataset"], "bc", "num_reads").collect()}
    assert got == {k: (*v, *outer[k[0]]) for k, v in want.items()}


def test_dominant_is_inclusive_and_by_either_measure(spark):
    data = [("d", "big", 0, "")] * 1 + [("d", f"b{i}", 1, "") for i in range(49)]
    got = {r.bc for r in dominant_keys(spark.createDataFrame(data, SCHEMA), ["dataset"], "bc", "num_reads").collect()}
    assert got == {"big", *(f"b{i}" for i in range(49))}  # each has exactly one in fifty of the rows
    data += [("d", "rich", 1000, ""), ("d", "one", 0, "")]
    got = {r.bc for r in dominant_keys(spark.createDataFrame(data, SCHEMA), ["dataset"], "bc", "num_reads").collect()}
    assert got == {"rich"}


def test_join_aggregate_equals_the_join(spark):
    left = spark.createDataFrame(_rows(2, 120), SCHEMA)
    right = spark.createDataFrame(_rows(3, 80), SCHEMA)
    got = join_aggregate(left, right, ["dataset"], ["bc"], ["bc"], ["num_reads"], ["num_reads"])
    left.createOrReplaceTempView("l")
    right.createOrReplaceTempView("r")
    want = spark.sql("SELECT l.bc a, r.bc b, count(*) n, sum(coalesce(l.num_reads, 0)) x, sum(coalesce(r.num_reads, 0)) y FROM l JOIN r ON l.dataset = r.dataset GROUP BY 1, 2")
    key = lambda rows: sorted(((r[0], r[1], int(r[2]), int(r[3]), int(r[4])) for r in rows), key=repr)
    assert key(got.collect()) == key(want.collect())


def test_large_counts_do_not_overflow(spark):
    one = spark.createDataFrame([(1, 9_000_000_000_000_000_000)], "k bigint, m bigint")
    two = spark.createDataFrame([(1, 1)] * 7, "k bigint, m bigint")
    assert int(join_aggregate(one, two, ["k"], left_measures=["m"]).first().left_m_sum) == 63_000_000_000_000_000_000


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert key_loads(empty, ["dataset"], "bc", "num_reads").count() == 0
    assert dominant_keys(empty, ["dataset"], "bc", "num_reads").count() == 0
    assert join_aggregate(empty, spark.createDataFrame(_rows(1, 5), SCHEMA), ["dataset"], ["bc"]).count() == 0
