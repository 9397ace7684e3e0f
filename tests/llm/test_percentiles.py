from bisect import bisect_left, bisect_right
import math
import random

import numpy as np
import pytest

from fragloom.llm.percentiles import PERCENTS, collapse, merge_sketches, percentile_sketches, percentiles
from fragloom.session import Scratch

SCHEMA = "g string, day int, v double, n string, weight int"


def check(rows, groups, got, size):
    """Every percentile's rank lies within the stated error."""
    by = {}
    for g, d, v, *_ in rows:
        if v is not None and not math.isnan(v):
            by.setdefault(tuple({"g": g, "day": d}[c] for c in groups), []).append(v)
    assert {tuple(r[c] for c in groups) for r in got} == set(by)
    for r in got:
        own = np.sort(by[tuple(r[c] for c in groups)])
        assert r.n == len(own)
        for p in PERCENTS:
            rank = max(1, math.ceil(len(own) * p / 100))
            value = r[f"p{p:02d}"]
            low, high = np.searchsorted(own, value, "left") + 1, np.searchsorted(own, value, "right")
            assert low - r.max_rank_error <= rank <= high + r.max_rank_error
        # leaf, tree and merge add half an output weight each, and weights are rounded up
        assert r.max_rank_error <= max(1, 2 * len(own) / size + 8)


@pytest.mark.parametrize("size", [8, 64, 4096])
def test_error_is_bounded_and_sketches_combine(spark, size):
    r = random.Random(size)
    values = lambda: r.choice([r.gauss(0, 1), float(r.randint(0, 5)), 7.0, None, float("nan")])
    rows = [(r.choice(["a"] * 8 + ["b", None]), r.randint(1, 3), values(), "x", 1) for _ in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    fine = percentile_sketches(df, ["g", "day"], "v", Scratch(spark, "t"), size)
    check(rows, ["g", "day"], percentiles(fine).collect(), size)
    check(rows, ["g"], percentiles(merge_sketches(fine, ["g"], size)).collect(), size)
    if size == 4096:
        assert all(r.max_rank_error == 0 for r in percentiles(fine).collect())


def test_empty_and_all_null(spark):
    for rows in ([], [("a", 1, None, "", 0)]):
        fine = percentile_sketches(spark.createDataFrame(rows, SCHEMA), ["g"], "v", Scratch(spark, "t"))
        assert percentiles(fine).count() == 0 and merge_sketches(fine, ["g"]).count() == 0


def test_collapse_keeps_ranks():
    rng = np.random.default_rng(0)
    vals, weights = rng.normal(size=500), rng.integers(1, 9, 500)
    kept, w = collapse(vals, weights, 50)
    assert len(kept) <= 50 and list(kept) == sorted(kept)
    for x in np.linspace(-2, 2, 9):
        assert abs((kept <= x).sum() * w - weights[vals <= x].sum()) <= w / 2 + 1


def test_one_large_partition_holds_few_buffers(spark, monkeypatch):
    from fragloom.llm import percentiles as pe

    monkeypatch.setattr(pe, "FAN_IN", 3)
    monkeypatch.setattr(pe, "RUN", 1)
    r = random.Random(3)
    rows = [("hot" if i % 3 else "cold", float(r.randint(0, 5_000))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, v double").coalesce(1)
    got = pe.percentiles(pe.percentile_sketches(df, ["g"], "v", Scratch(spark, "t"), size=32)).collect()
    for x in got:
        own = sorted(v for g, v in rows if g == x.g)
        assert x.n == len(own) and x.max_rank_error < x.n / 4
        for p in pe.PERCENTS:
            v, rank = x[f"p{p:02d}"], max(1, -(-len(own) * p // 100))
            assert bisect_left(own, v) + 1 - x.max_rank_error <= rank <= bisect_right(own, v) + x.max_rank_error
