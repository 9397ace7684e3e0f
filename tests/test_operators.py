import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragloom.functions import stats, text
from fragloom.operators import candidates, graph, qc, windows
from fragloom.operators.components import components
from fragloom.operators.rangejoin import nearest_join, overlap_join
from fragloom.session import Scratch
from fragloom.sources import vcf


def test_tails():
    assert stats.binomial_tail(7, 10, 0.5) == pytest.approx(0.0546875)
    assert stats.fisher_tail(3, 1, 1, 3) == pytest.approx(0.242857, abs=1e-6)
    assert stats.binomial_tail(10, 10, 0.5) == 0 and stats.binomial_tail(-1, 10, 0.5) == 1


def test_facing_and_labels(spark):
    from pyspark.sql import functions as F

    rows = [("c", 1000, "-", 1500, "+"), ("c", 1000, "-", 6000, "+"), ("c", 1000, "-", 150000, "+"), ("c", 6000, "+", 1000, "-"), ("c", 1, "+", 9, "-")]
    df = spark.createDataFrame(rows, "c string, x bigint, ox string, y bigint, oy string")
    got = [r[0] for r in df.select(text.facing(F.col("c"), F.col("x"), F.col("ox"), F.col("c"), F.col("y"), F.col("oy"))).collect()]
    assert got == ["bad", "facing", "breakpoint", "facing", "breakpoint"]
    assert df.select(text.revcomp(F.lit("ACGTN"))).first()[0] == "NACGT"
    back = df.select(text.breakend_from_label(F.lit("chr:1,234,567+")).alias("b")).first().b
    assert tuple(back) == ("chr", 1234567, "+")
    assert sorted(["s10", "s2"], key=text.natural_key) == ["s2", "s10"]


def test_alt(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[vcf.alt(F.lit("A"), F.lit("chr2"), F.lit(100), F.lit(o)) for o in ("+-", "++", "-+", "--")]).first()
    assert tuple(row) == ("A[chr2:100[", "A]chr2:100]", "]chr2:100]A", "[chr2:100[A")


def test_straddle(spark):
    chroms = spark.createDataFrame([("c", 0, 100_000)], "chrom string, idx int, length bigint")
    rows = [("in", 12000, 18000), ("left", 9000, 11000), ("touch", 10000, 15000), ("over", 5000, 25000)]
    f = spark.createDataFrame([("d", "c", s, e, b) for b, s, e in rows], "dataset string, chrom string, start_pos bigint, end_pos bigint, bc string")
    assert {r.bc for r in windows.window_barcodes(f, chroms).where("w = 1").collect()} == {"left", "over"}


def test_overlap_join_against_theta(spark):
    rng = np.random.default_rng(0)
    a = [(int(i % 3), int(s), int(s + l)) for i, (s, l) in enumerate(zip(rng.integers(0, 900, 80), rng.integers(-5, 120, 80)))]
    b = [(int(i % 3), int(s), int(s + l)) for i, (s, l) in enumerate(zip(rng.integers(0, 900, 60), rng.integers(-5, 60, 60)))]
    left, right = spark.createDataFrame(a, "k int, a bigint, b bigint"), spark.createDataFrame(b, "k int, c bigint, d bigint")
    got = sorted(map(tuple, overlap_join(left, right, ["k"], ("a", "b"), ("c", "d"), 50).select("k", "a", "b", "c", "d").collect()))
    assert got == sorted((k, s, e, x, y) for k, s, e in a for j, x, y in b if j == k and s <= e and x <= y and s <= y and x <= e)


def test_nearest_keeps_ties(spark):
    p = spark.createDataFrame([(1, "c", 100)], "id int, chrom string, pos bigint")
    i = spark.createDataFrame([("c", 0, 91, "l"), ("c", 110, 120, "r"), ("c", 300, 310, "far")], "chrom string, s bigint, e bigint, name string")
    got = nearest_join(p, i, ["chrom"], ["id"], "pos", "s", "e", 50, 100).collect()
    assert sorted((r.name, r.distance) for r in got) == [("l", 10), ("r", 10)]


def test_components_and_free_clustering(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200), (None, 3)], "u bigint, v bigint")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    pts = [(1, 0, 0), (2, 3000, 4000), (3, 3000, 8999), (4, 90000, 0)]
    df = spark.createDataFrame([(i, "a", x, "b", y, "++") for i, x, y in pts], "event_id bigint, chromx string, x bigint, chromy string, y bigint, orientation string")
    of = {r.event_id: r.cluster for r in candidates.cluster_points(df, Scratch(spark, "t")).collect()}
    assert of == {1: 1, 2: 2, 3: 2, 4: 4}  # a distance of exactly 5000 does not link


def test_runs_of_positions(spark):
    p = spark.createDataFrame([("c", 0), ("c", 3000), ("c", 6001)], "chrom string, pos bigint")
    assert {(r.pos, r.clustered) for r in graph.precluster(p).collect()} == {(0, 1500), (3000, 1500), (6001, 6001)}


def _sequential(edges):
    left, out = dict(edges), set()
    while left:
        best = max(left, key=lambda e: (left[e], e))
        out.add(best)
        left = {e: w for e, w in left.items() if not set(e) & set(best)}
    return out


def test_best_edges_equal_the_sequential_rule(spark):
    rng = np.random.default_rng(1)
    edges = {}
    for a, b in rng.integers(0, 25, (70, 2)):
        if a != b:
            edges[f"n{min(a, b):02d}", f"n{max(a, b):02d}"] = round(float(rng.random()), 1)
    df = spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "u string, v string, ratio double")
    assert {(r.u, r.v) for r in graph.best_edges(df, Scratch(spark, "t")).collect()} == _sequential(edges)


@pytest.mark.parametrize("most", [100, 200_000])
def test_best_edges_of_a_long_chain_are_never_lost(spark, most):
    n = 3_000 if most > 3_000 else 500
    df = spark.createDataFrame([(f"n{i:05d}", f"n{i + 1:05d}", i / n) for i in range(n)], "u string, v string, ratio double")
    got = graph.best_edges(df, Scratch(spark, "t"), rounds=2, most=most).collect()
    assert {r.u for r in got} == {f"n{i:05d}" for i in range(n - 1, -1, -2)}


def test_cleaning_breaks_cycles_and_trims_facing_ends(spark):
    rows = [("k", "a", "b", "breakpoint", 1e-9), ("k", "b", "c", "facing", 1e-5), ("k", "a", "c", "breakpoint", 1e-6), ("k", "c", "d", "facing", 1e-5)]
    df = spark.createDataFrame(rows, "cluster string, u string, v string, kind string, p double")
    # the edge with the least p goes first, then b and d hang on facing edges alone
    assert {(r.u, r.v) for r in graph.clean_components(df).collect()} == {("a", "c")}
    path = graph.event_paths(spark.createDataFrame([("k", "a", "b", "x", 1.0), ("k", "b", "c", "y", 1.0)], df.schema)).orderBy("step").collect()
    assert [(r.u, r.v, r.kind) for r in path] == [("a", "b", "x"), ("b", "c", "y")]


def _step_by_step(edges):
    """Indices that go: the first edge at a node of a cycle, again and again; a node is on a cycle if one of its edges is no bridge."""

    def reach(a, left):
        seen, todo = {a}, [a]
        for n in todo:
            for u, v in left:
                for x, y in ((u, v), (v, u)):
                    if x == n and y not in seen:
                        seen.add(y)
                        todo.append(y)
        return seen

    left, gone = dict(enumerate(edges)), set()
    while True:
        on = {n for i, (u, v) in left.items() if v in reach(u, [e for j, e in left.items() if j != i]) for n in (u, v)}
        first = next((i for i, e in left.items() if set(e) & on), None)
        if first is None:
            return gone
        gone.add(first)
        del left[first]


def test_cleaning_equals_removal_step_by_step():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n = int(rng.integers(3, 10))
        pairs = {tuple(sorted((f"n{a}", f"n{b}"))) for a, b in rng.integers(0, n, (int(rng.integers(2, 16)), 2)) if a != b}
        edges = [tuple(e) for e in rng.permutation(sorted(pairs)).tolist()] if pairs else []
        assert {i for i, out in enumerate(graph._cycle_ranks(edges)) if out} == _step_by_step(edges)


def test_a_large_cluster_is_cleaned_in_one_pass():
    edges = [e for i in range(60_000) for e in ((f"a{i}", f"a{i + 1}"), (f"a{i}", f"b{i}"), (f"b{i}", f"a{i + 1}"))]
    began = time.monotonic()
    gone = graph._cycle_ranks(edges)
    assert time.monotonic() - began < 30 and len(gone) == 180_000 and gone[0] and sum(gone) >= 60_000


def test_facing_edges_need_common_barcodes(spark):
    best = [("a", "b", 1, "1", 10_000, "2", 50_000, "+-"), ("c", "d", 2, "2", 70_000, "3", 20_000, "+-"), ("e", "f", 3, "4", 10_000, "5", 50_000, "+-"), ("g", "h", 4, "5", 70_000, "6", 20_000, "+-")]
    best = spark.createDataFrame(best, "u string, v string, event_id bigint, chromx string, x bigint, chromy string, y bigint, orientation string")
    rows = []
    for i in range(30):
        # the same barcodes cross 1 and 2, different ones 3 and 4, which lie just as near
        rows += [("1", 5_000, 10_000, f"s{i}"), ("2", 50_000, 70_000, f"s{i}"), ("3", 20_000, 25_000, f"s{i}")]
        rows += [("4", 5_000, 10_000, f"l{i}"), ("5", 50_000, 55_000, f"l{i}"), ("5", 65_000, 70_000, f"r{i}"), ("6", 20_000, 25_000, f"r{i}")]
    rows += [("9", 100, 200, f"o{i}") for i in range(300)]
    frags = spark.createDataFrame([(i, "d", *r, 1) for i, r in enumerate(rows)], "frag_id bigint, dataset string, chrom string, start_pos bigint, end_pos bigint, bc string, hap int")
    events = best.select("event_id", F.lit("d").alias("dataset"), "chromx", "x", "chromy", "y", "orientation")
    got = graph.supported_facing_edges(best, events, frags).collect()
    assert [(r.u, r.v, r.kind, r.shared, r.total) for r in got] == [("2:000000050000:-", "2:000000070000:+", "facing", 30, 30)] and got[0].p < 1e-20
    assert graph.supported_facing_edges(best, events, frags, min_shared=31).count() == 0


def test_peaks_apart(spark):
    cells = [(1, "++", 0, 0, 30, 40), (1, "++", 10, 0, 30, 50), (1, "++", 11, 0, 30, 60), (1, "++", 40, 0, 25, 400)]
    df = spark.createDataFrame(cells, "region_id int, orientation string, bx bigint, `by` bigint, n bigint, total bigint")
    assert {r.bx for r in candidates.peaks(df).collect()} == {0, 11}


def test_steepest_drop():
    d = np.array([0, 1, 5, 5, 5, 1, 0, 0])
    # from the peak at 2: a fall of 4 at distance 3 is less steep than one of 5 at distance 4
    assert candidates.steepest_drop(d, True) == 6
    assert candidates.steepest_drop(d[::-1], False) == 1
    assert candidates.steepest_drop(np.zeros(4), True) == 0


def test_ascending_n50_and_trim(spark):
    v = spark.createDataFrame([("d", x) for x in (1, 1, 2, 4)], "dataset string, len bigint")
    assert qc.n50(v).first().n50 == 2
    w = spark.createDataFrame([("d", x) for x in (5, 5, 5, 900)], "dataset string, len bigint")
    assert qc.trim_outliers(w, ["dataset"], "len").count() == 4
