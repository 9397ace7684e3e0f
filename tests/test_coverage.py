import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fragloom.operators.coverage import coverage_gaps, merge_intervals

SCHEMA = "bc string, start_pos bigint, end_pos bigint, shard string, s int, k0 string"


def brute(rows):
    stretches, gaps = [], []
    by = {}
    for b, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(b, []).append((s, e))
    for b, own in by.items():
        own.sort()
        a, z = own[0]
        for s, e in own[1:]:
            if s <= z:
                z = max(z, e)
            else:
                stretches.append((b, a, z))
                gaps.append((b, z, s))
                a, z = s, e
        stretches.append((b, a, z))
    return sorted(stretches, key=repr), sorted(gaps, key=repr)


def check(spark, rows, bits=4):
    df = spark.createDataFrame([(b, s, e, "x", 1, "y") for b, s, e in rows], SCHEMA)
    stretches, gaps = brute(rows)
    assert sorted(map(tuple, merge_intervals(df, ["bc"], shard_bits=bits).collect()), key=repr) == stretches
    assert sorted(map(tuple, coverage_gaps(df, ["bc"], shard_bits=bits).collect()), key=repr) == gaps


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-60, 200)), st.one_of(st.none(), st.integers(-60, 260))), max_size=30))
def test_random(spark, rows):
    check(spark, rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [("a", 1, 5), ("a", 5, 9)],  # touching
        [("a", 0, 16), ("a", 16, 32)],  # touching at the edge of a shard
        [("a", 3, 200), ("a", 40, 44), ("a", 60, 61), ("a", 300, 301)],  # shards wholly covered hide what is in them
        [("a", 0, 2), ("a", 20, 90), ("a", 50, 52), ("a", 95, 96)],
        [("a", 5, 5), ("a", 9, 3), ("a", None, 4), (None, 1, 2), (None, 8, 9)],
        [("a", 1, 2)] * 50 + [("a", 7, 8)] * 50,
        [("a", -(2**40), 2**40), ("a", 2**41, 2**41 + 1)],  # a very long one makes no more than three pieces
    ],
)
def test_cases(spark, rows):
    check(spark, rows)


def test_one_hot_entity(spark):
    r = random.Random(5)
    rows = [("hot", s, s + r.randint(1, 40)) for s in (r.randint(0, 20_000) for _ in range(800))] + [("b", 1, 3)]
    check(spark, rows, bits=8)
