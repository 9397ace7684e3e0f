import random
import time
from collections import defaultdict

import numpy as np
import pytest

from fragloom.llm.cutting import GAP, best_mix, best_mixes
from fragloom.llm.packing import pack
from fragloom.llm.tokens import token_counts
from fragloom.session import Scratch

SCHEMA = "doc_id bigint, n_tokens bigint, bin string, size string"


def check(rows, targets, got):
    """Every document is whole, in order and in room; none is split that need not be."""
    by, load = defaultdict(list), defaultdict(int)
    for r in got:
        by[r.container, r.doc_id].append((r.piece, r.size))
        load[r.container, r.bin] += r.size
    for name, capacity in targets:
        assert {d for c, d in by if c == name} == {d for d, *_ in rows}
        for d, n, *_ in rows:
            own = sorted(by[name, d])
            assert [p for p, _ in own] == list(range(len(own)))
            assert sum(s for _, s in own) == max(n or 0, 0)
            assert len(own) == max(1, -(-max(n or 0, 0) // capacity))
        assert all(v <= capacity for (c, _), v in load.items() if c == name)
    return load


def test_everything_has_its_place_and_little_room_is_left(spark):
    r = random.Random(0)
    rows = [(i, min(5000, int(r.lognormvariate(5, 1.2))), "", "") for i in range(3000)]
    targets = [("short", 512), ("long", 2048)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    load = check(rows, targets, pack(df, targets, Scratch(spark, "t")).collect())
    for name, capacity in targets:
        own = [v for (c, _), v in load.items() if c == name]
        assert sum(own) / (len(own) * capacity) > 0.96


@pytest.mark.parametrize("n", [[], [0], [None, -3, 0], [512] * 5, [1] * 40, [300] * 9, [100_000], [511, 1, 513, 1024, 200, 200]])
def test_cases(spark, n):
    rows = [(i, x, "", "") for i, x in enumerate(n)]
    check(rows, [("short", 512)], pack(spark.createDataFrame(rows, SCHEMA), [("short", 512)], Scratch(spark, "t")).collect())


def test_small_shards(spark):
    rows = [(i, 1 + i % 90, "", "") for i in range(700)]
    check(rows, [("short", 512)], pack(spark.createDataFrame(rows, SCHEMA), [("short", 512)], Scratch(spark, "t"), shard=50).collect())


def test_capacity_must_be_sensible(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], SCHEMA), [("none", 0)], Scratch(spark, "t"))


def test_mixes_cover_the_demand_in_few_containers():
    rng = np.random.default_rng(2)
    sizes = sorted(rng.choice(np.arange(60, 500), 20, replace=False).tolist(), reverse=True)
    counts = rng.integers(1, 200, 20).tolist()
    mixes, gap = best_mixes(sizes, counts, 512)
    assert 0 <= gap <= GAP
    assert all(m @ np.array(sizes) <= 512 for m, _ in mixes)
    assert (sum(m * t for m, t in mixes) >= counts).all()
    used, need = sum(t for _, t in mixes), sum(s * c for s, c in zip(sizes, counts)) / 512
    assert used <= need * 1.12 + 20


def test_best_mix_against_all_mixes():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes, worth = np.sort(rng.choice(np.arange(5, 30), 4, replace=False))[::-1], rng.random(4)
        worth[rng.integers(4)] = 0.0
        value, mix = best_mix(sizes, worth, 60)
        every = max((np.array(m) @ worth for m in np.ndindex(*(60 // sizes + 1)) if np.array(m) @ sizes <= 60))
        assert value == pytest.approx(every) and mix @ sizes <= 60 and mix @ worth == pytest.approx(every)


@pytest.mark.parametrize("capacity", [512, 8_192, 131_072])
def test_every_capacity_ends_within_the_gap(capacity):
    rng = np.random.default_rng(capacity)
    sizes = np.unique(rng.integers(capacity // 6 + 1, capacity + 1, 48))[::-1].tolist()
    counts = rng.integers(1, 1_000_000, len(sizes)).tolist()
    began = time.monotonic()
    mixes, gap = best_mixes(sizes, counts, capacity)
    assert gap <= GAP and time.monotonic() - began < 60
    used, bound = sum(t for _, t in mixes), sum(s * c for s, c in zip(sizes, counts)) / capacity
    assert bound <= used and (sum(m * t for m, t in mixes) >= counts).all()


def test_tokens(spark):
    long = "def f(x):\n    return x\n" * 20_000
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, long)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 100_000
