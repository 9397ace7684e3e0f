import random

import pytest
from pyspark.sql import functions as F

from fragloom.llm.components import connected_groups, group_rows
from fragloom.session import Scratch


def brute(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def run(spark, links):
    df = spark.createDataFrame(links, "u bigint, v bigint")
    return {r.vertex: r.group_id for r in connected_groups(df, Scratch(spark, "t")).collect()}


@pytest.mark.parametrize(
    "links",
    [
        [],
        [(i, i + 1) for i in range(60)],  # a sorted chain
        [(i, 0) for i in range(1, 80)] + [(i, 1000) for i in range(40, 80)],  # stars
        [(1, 1), (2, 2), (None, 3), (4, None)],
        [(1, 2), (2, 1), (1, 2), (5, 6)],
    ],
)
def test_shapes(spark, links):
    assert run(spark, links) == brute(links)


def test_random(spark):
    r = random.Random(3)
    links = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)]
    assert run(spark, links) == brute(links)


def test_rows_by_shared_keys(spark):
    rows = [(1, 7, "p"), (2, None, "p"), (3, 7, None), (4, None, None), (5, -1, "q"), (6, -1, "r"), (None, 7, "p"), (3, 7, None)]
    df = spark.createDataFrame(rows, "id bigint, cluster bigint, key string").withColumn("u", F.lit(0)).withColumn("group_id", F.lit("clash"))
    keys = [F.when(F.col("cluster") != -1, F.concat(F.lit("c"), "cluster")), F.concat(F.lit("k"), "key")]
    got = {r.id: r.group_id for r in group_rows(df, "id", keys, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
