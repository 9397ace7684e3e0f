import numpy as np
import pytest
from pyspark.sql import functions as F

from fragloom.functions.stats import fisher_tail
from fragloom.operators import candidates, evidence, genotype, support
from fragloom.operators.tips import TILE, Tips, _ordered, steepest_drops


@pytest.fixture(scope="module")
def tables(spark):
    """Events and fragments at random, with hot barcodes, over the edge of two files of tips; some rows are delivered twice."""
    rng = np.random.default_rng(1)
    at = lambda n: (TILE - 15_000 + rng.integers(0, 30_000, n)).tolist()
    pick = lambda of, n: [of[i] for i in rng.integers(0, len(of), n)]
    n = 900
    start = at(n)
    rows = list(zip(range(n), pick(["d", "e", "f"], n), pick(["1", "2/x", None], n), start, [s + int(k) for s, k in zip(start, rng.integers(-50, 9_000, n))], pick(["hot", "warm", *[f"b{i}" for i in range(60)], None], n), pick([0, 1, 2, None], n)))
    f = spark.createDataFrame(rows, "frag_id bigint, dataset string, chrom string, start_pos bigint, end_pos bigint, bc string, hap int")
    m = 40
    events = list(zip(range(m), pick(["1", "2/x"], m), at(m), pick(["1", "2/x"], m), at(m), pick(["++", "+-", "-+", "--"], m)))
    return spark.createDataFrame(events, "event_id bigint, chromx string, x bigint, chromy string, y bigint, orientation string"), f, f.unionByName(f.limit(200))


def rows_of(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_refined_breakends_come_from_tips(spark, tables):
    events, f, twice = tables
    ends = support.breakends(events)
    near = support.near_breakends(ends, f, ["event_id", "side"], -6_000, 6_000)
    names = ["event_id", "side", "pos", "new_pos", "n"]
    assert rows_of(Tips(twice).refined(ends, 6_000), names) == rows_of(candidates.refine_breakends(near, ["event_id", "side"], 6_000), names)


def test_drops_without_every_position():
    rng = np.random.default_rng(0)
    for _ in range(300):
        width, n = int(rng.integers(1, 30)), int(rng.integers(0, 25))
        end, low, high, plus = np.sort(rng.integers(0, 4, n)), rng.integers(0, width + 1, n), rng.integers(0, width + 1, n), rng.random(4) < 0.5
        own, to, count = steepest_drops(end, low, high, plus, width)
        want = {}
        for e in np.unique(end[low < high]):
            mine = (end == e) & (low < high)
            cover = np.array([((low <= i) & (high > i))[mine].sum() for i in range(width)])
            want[int(e)] = (candidates.steepest_drop(cover, plus[e]), int(mine.sum()))
        assert {int(e): (int(t), int(k)) for e, t, k in zip(own, to, count)} == want


def test_counts_confirmations_crossings_and_lengths_come_from_tips(spark, tables):
    events, f, twice = tables
    own, ends = Tips(twice), support.breakends(events)
    per = support.support_by_barcode(events, f, -500, 5_000).cache()
    wide = support.support_by_barcode(events, f, -500, 12_000)
    crossed = (F.col("nx") > 0) & (F.col("ny") > 0)
    names = ["event_id", "dataset", "shared", "total", "only_x", "only_y", "x_hap0", "x_hap1", "y_hap0", "y_hap1"]
    haps = [F.sum(F.when(crossed, F.col(f"h{s}{h}") * F.col("ny" if s == "x" else "nx") - F.col(f"h{s}{h}_same")).otherwise(0)).alias(f"{s}_hap{h}") for s in "xy" for h in "01"]
    want = per.groupBy("event_id", "dataset").agg(F.count_if(crossed).alias("shared"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("ny") == 0).alias("only_x"), F.count_if(F.col("nx") == 0).alias("only_y"), *haps)
    got = own.quantify(events, ends, -500, 5_000, quantiles=(0.5, 0.9)).cache()
    assert rows_of(got, names) == rows_of(want, names) and want.where("shared > 1").count() > 5
    good = {r.dataset: r.n for r in f.where("bc IS NOT NULL").groupBy("dataset").agg(F.count_distinct("bc").alias("n")).collect()}
    assert own.good == good
    assert all(r.p_fisher == pytest.approx(fisher_tail(r.shared, r.only_x, r.only_y, good[r.dataset] - r.total)) for r in got.collect())
    q = F.percentile("len", F.array(F.lit(0.5), F.lit(0.9)))
    lengths = genotype.joined_lengths(events, f).groupBy("event_id", "dataset").agg(q.alias("q")).select("event_id", "dataset", F.col("q")[0].alias("lengths_50"), F.col("q")[1].alias("lengths_90"))
    assert rows_of(got.where("lengths_50 IS NOT NULL"), lengths.columns) == rows_of(lengths, lengths.columns)
    more = wide.where(crossed).groupBy("event_id", "dataset").agg(F.count(F.lit(1)).alias("confirming"))
    both = want.select("event_id", "dataset", "shared", "total").join(more, ["event_id", "dataset"], "left").fillna(0).where("shared > 0 OR confirming > 0")
    assert rows_of(own.confirmed(events, ends, -500, 5_000, 12_000), both.columns) == rows_of(both, both.columns)
    each = own.crossing(events, ends, -500, 5_000).groupBy("event_id", "dataset").agg(F.count_distinct("bc").alias("n"), F.count(F.lit(1)).alias("m"))
    assert rows_of(each, each.columns) == rows_of(want.where("shared > 0").select("event_id", "dataset", F.col("shared").alias("n"), F.col("shared").alias("m")), each.columns)


def test_equal_parts_of_hashes_are_told_apart():
    rng = np.random.default_rng(0)
    event, bc = rng.integers(0, 3, 400), rng.integers(0, 5, 400) + (rng.integers(0, 2, 400) << 60)
    order, new = _ordered(event, bc)
    assert new.sum() == len(set(zip(event, bc))) == len({(event[i], bc[i]) for i in order[new]})


def test_each_pair_of_sizes_is_drawn_once(spark):
    totals = spark.createDataFrame([("d", f"b{i}", 1 + i % 3) for i in range(300)], "dataset string, bc string, num_reads bigint")
    q = spark.createDataFrame([(i, "d", i % 2, 3, 3) for i in range(400)], "event_id bigint, dataset string, shared bigint, only_x bigint, only_y bigint")
    got = evidence.resampling_p(q, totals).collect()
    assert len(got) == 400 and len({(r.shared, r.p_resampling) for r in got}) == 2


def test_nested_draws_follow_the_weights():
    reads, n = np.array([1, 5, 400]), np.array([3_000, 400, 1])
    sampler = evidence._Resampler(reads, n, 400, 0)
    assert sampler.nested > 300
    small, large = sampler.of(0, 20), sampler.of(0, 300)
    assert (small.sum(axis=1) == 20).all() and (large.sum(axis=1) == 300).all() and (small <= large).all() and (large <= n).all()
    other = evidence.draws(np.random.default_rng(1), sampler.weights, n, 300, 400)
    assert np.allclose(large.mean(axis=0), other.mean(axis=0), rtol=0.03, atol=0.5)
    assert (sampler.of(1, 3_401) == n).all() and (sampler.of(1, 5_000) == n).all()
