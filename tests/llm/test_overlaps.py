import datetime
import random
from itertools import combinations

from fragloom.llm.overlaps import PairCounts, open_counts
from fragloom.llm.sets_and_groups import p5_overlaps
from fragloom.session import Scratch

SCHEMA = "set_name string, id string, present boolean, seq bigint, d string, other string"


def test_joining_and_leaving_against_brute_force(spark):
    r = random.Random(1)
    counts, state = PairCounts(Scratch(spark, "t")), {}
    for batch in range(4):
        rows = []
        for seq in range(60):
            s, i = r.choice(["a", "b", "c", "d"]), r.choice(["HOT"] + [f"i{k}" for k in range(12)])
            rows.append((s, i, r.random() < (0.9 if batch == 0 else 0.5), seq, "x", "y"))
        rows += [(None, "i1", True, 1, "", ""), ("a", None, True, 1, "", ""), ("a", "i1", None, 999, "", ""), rows[0]]
        for s, i, p, _, _, _ in sorted((x for x in rows if None not in x[:3]), key=lambda x: (x[3], x[2])):
            state.setdefault(s, set())
            (state[s].add if p else state[s].discard)(i)
        counts.apply(spark.createDataFrame(rows, SCHEMA))
        want = {(a, b): (len(state[a]), len(state[b]), len(state[a] & state[b]), len(state[a] | state[b])) for a, b in combinations(sorted(state), 2) if state[a] & state[b]}
        assert {(x.set_a, x.set_b): tuple(x)[2:] for x in counts.overlaps().collect()} == want


def test_empty_batches(spark):
    counts = PairCounts(Scratch(spark, "t"))
    none = spark.createDataFrame([], SCHEMA)
    counts.apply(none)
    assert counts.overlaps().count() == 0
    counts.apply(spark.createDataFrame([("a", "x", True, 1, "", ""), ("b", "x", True, 1, "", "")], SCHEMA))
    counts.apply(none)
    assert [tuple(r) for r in counts.overlaps().collect()] == [("a", "b", 1, 1, 1, 1)]


def test_rows_without_a_time_are_counted(spark, tmp_path):
    spark.createDataFrame([("1", 0, 1000, "chr1", "A1"), ("2", 1, 1000, "chr2", "A2")], "chrom string, idx int, length bigint, alias_name string, accession string").write.parquet(f"{tmp_path}/chroms.parquet")
    codes = ["".join("ACGT"[(i >> 2 * k) & 3] for k in range(16)) + "-1" for i in range(30)]
    for name, timed in (("some", lambda i: i % 3), ("none", lambda i: False)):
        at = lambda i: datetime.datetime(2024, 1, 1 + i % 28) if timed(i) else None
        rows = [("d", c, b, at(i)) for i, b in enumerate(codes) for c in ("1", "2") if c == "1" or i % 2]
        (tmp_path / name).mkdir()
        (tmp_path / name / "chroms.parquet").symlink_to(tmp_path / "chroms.parquet")
        spark.createDataFrame(rows, "dataset string, chrom string, bc string, delivered_at timestamp").write.parquet(f"{tmp_path}/{name}/fragments.parquet")
        assert [tuple(r)[2:] for r in p5_overlaps(spark, f"{tmp_path}/{name}").collect()] == [(30, 15, 15, 30)]


def test_the_state_can_be_opened_again(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    rows = lambda *r: spark.createDataFrame([(s, i, p, 1, "", "") for s, i, p in r], SCHEMA)
    one = PairCounts(Scratch(spark, "t"), root, buckets=4)
    one.apply(rows(("a", "x", True), ("b", "x", True), ("a", "y", True), ("c", "y", True)))
    two = open_counts(spark, root)
    assert two.buckets == 4
    two.apply(rows(("a", "x", False), ("b", "y", True), ("a", "z", False)))
    want = [("a", "b", 1, 2, 1, 2), ("a", "c", 1, 1, 1, 1), ("b", "c", 2, 1, 1, 2)]
    assert sorted(map(tuple, open_counts(spark, root).overlaps().collect())) == want
    before = two.overlaps()
    two.close()
    assert sorted(map(tuple, before.collect())) == want
    two = open_counts(spark, root)
    small = two.compact(f"file://{tmp_path}/small")
    assert sorted(map(tuple, small.overlaps().collect())) == want
    assert spark.read.parquet(f"{tmp_path}/small/members").where("d < 0").count() == 0


def test_a_batch_leaves_the_memberships_where_they_are(spark):
    counts = PairCounts(Scratch(spark, "t"), buckets=4)
    counts.apply(spark.createDataFrame([("a", f"i{k}", True, 1, "", "") for k in range(50)], SCHEMA))
    plan = counts._net(spark.createDataFrame([("b", "i1", True, 1, "", "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    # one shuffle folds the batch and one takes it to the buckets; the log is grouped and joined without one
    assert plan.count("Exchange hashpartitioning") <= 2 and "Bucketed: true" in plan


def test_forgotten_counts_leave_nothing(spark, tmp_path):
    counts = PairCounts(Scratch(spark, "t"), f"file://{tmp_path}/gone")
    counts.forget()
    assert not (tmp_path / "gone").exists() and not [t for t in spark.catalog.listTables() if t.name == counts._log]
