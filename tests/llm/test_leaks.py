import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragloom.llm.automaton import SuffixAutomaton, words
from fragloom.llm.leaks import LeakFinder, leak_spans, leaked_items, least_run, stretches, without_leaks

WORDS = [f"w{i}" for i in range(30)]


def passage(item, text, length=40, one_in=10):
    """Brute force: some stretch of the item of at least ``length`` words lies in the text with few enough words touched."""
    n, m = len(item), len(text)
    for i in range(n - length + 1):
        row = [0] * (m + 1)
        for k in range(i, n):
            new = [k - i + 1]
            for j in range(1, m + 1):
                new.append(min(row[j - 1] + (item[k] != text[j - 1]), row[j] + 1, new[j - 1] + 1))
            row = new
            size = k - i + 1
            if size >= length and min(row) * one_in <= size:
                return True
    return False


def touched(r, item, edits):
    out = list(item)
    for _ in range(edits):
        at = r.randrange(len(out))
        kind = r.choice("cal")
        if kind == "c":
            out[at] = "zzz"
        elif kind == "a":
            out.insert(at, r.choice(WORDS))
        else:
            del out[at]
    return out


def test_least_run():
    assert least_run() == 8


def test_words_follow_the_definition():
    assert words("Foo_bar, BAZ-9Äb x__y") == ["foo", "bar", "baz", "9äb", "x", "y"]


def test_seeds_against_brute_force():
    r = random.Random(1)
    texts = [[r.choice(WORDS[:5]) for _ in range(60)] for _ in range(3)] + [["a"] * 12, []]
    a = SuffixAutomaton(texts, 3)
    joined = [w for t in texts for w in t]
    part = [n for n, t in enumerate(texts) for _ in t]
    text = [r.choice([*WORDS[:5], "q"]) for _ in range(200)]
    want = {(j, e) for j in range(2, 200) for e in range(2, len(joined)) if part[e] == part[e - 2] and text[j - 2 : j + 1] == joined[e - 2 : e + 1]}
    js, ends = a.seeds(a.ids(text))
    assert set(zip(js.tolist(), ends.tolist())) == want


@pytest.mark.parametrize("seed", range(4))
def test_passages_against_brute_force(seed):
    r = random.Random(seed)
    items = [[r.choice(WORDS) for _ in range(r.choice([39, 40, 55, 70]))] for _ in range(3)]
    finder = LeakFinder([(n, "prompt", " ".join(t)) for n, t in enumerate(items)])
    texts = []
    for _ in range(12):
        item = r.choice(items)
        a = r.randrange(0, max(1, len(item) - 38))
        texts.append([r.choice(WORDS) for _ in range(20)] + touched(r, item[a : a + r.choice([36, 40, 45, 70])], r.choice([0, 2, 4, 5, 7])) + [r.choice(WORDS) for _ in range(20)])
    got = {(at, n) for at, n, *_ in finder.find([" ".join(t) for t in texts])}
    assert got == {(at, n) for at, t in enumerate(texts) for n, item in enumerate(items) if passage(item, t)}


def test_alignment_of_exact_and_far_windows():
    item = np.arange(40, dtype=np.int32)[None]
    hit = np.full((1, 80), -1, dtype=np.int32)
    hit[0, 10:50] = item
    assert stretches(item, hit, 20, 40, 10) == [(0, 10, 49)]
    hit[0, 10:50:7] = -1
    assert not stretches(item, hit, 20, 40, 10)


def test_words_before_and_after_an_item_are_not_part_of_it():
    padded = np.full((1, 60), -2, dtype=np.int32)
    padded[0, 10:48] = np.arange(38)
    hit = np.full((1, 100), -1, dtype=np.int32)
    hit[0, 20:58] = np.arange(38)
    assert not stretches(padded, hit, 24, 40, 10)  # 38 words are too few, whatever lies around them


def test_many_blocks_and_long_items(spark):
    r = random.Random(4)
    names = [f"x{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(names) for _ in range(60)), None) for i in range(40)]
    long = [r.choice(names) for _ in range(40_000)]
    items.append((99, None, " ".join(long)))
    rows = []
    for i in range(60):
        own = r.choice(items[:40])[1].split()
        rows.append((i, " ".join([r.choice(names) for _ in range(30)] + touched(r, own[:50], i % 7) + [r.choice(names) for _ in range(30)])))
    rows.append((100, " ".join(["start"] * 5 + touched(r, long[20_000:20_100], 8) + ["end"])))
    rows.append((101, " ".join(long)))
    i, d = spark.createDataFrame(items, "item_id bigint, prompt string, solution string"), spark.createDataFrame(rows, "doc_id bigint, text string")
    one = sorted(map(tuple, leak_spans(d, i).collect()))
    many = sorted(map(tuple, leak_spans(d, i, block_words=2_000, share=3_000).collect()))
    assert one == many
    pairs = {(x[0], x[1]) for x in one}
    assert {(100, 99), (101, 99)} <= pairs and {d for d, _ in pairs} >= {i for i in range(60) if i % 7 <= 4}
    assert [x[3:] for x in one if x[0] == 101] == [(0, 39_999)]


def test_only_the_aligned_stretch_is_a_span():
    r = random.Random(6)
    item = [f"q{i}" for i in range(150)]
    text = [r.choice(WORDS) for _ in range(20)] + item[:45] + [r.choice(WORDS) for _ in range(60)] + item[105:115] + [r.choice(WORDS) for _ in range(20)]
    # the ten words further on lie on the same diagonal, but are too few for a passage
    assert LeakFinder([(1, "prompt", " ".join(item))]).find([" ".join(text)]) == [(0, 1, "prompt", 20, 64)]


def test_tables(spark):
    r = random.Random(9)
    item = [r.choice(WORDS) for _ in range(50)]
    items = spark.createDataFrame([(1, " ".join(item), None, "x"), (2, "too short", "", "x"), (None, " ".join(item), "", "x"), (3, None, " ".join(item), "x")], "item_id bigint, prompt string, solution string, doc_id string")
    leak = "start, " + " ".join(item[:45]).upper() + "; end"
    rows = [(1, leak), (1, leak), (2, None), (3, ""), (4, "nothing"), (5, "word " * 200_000 + " ".join(item)), (6, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    assert {tuple(x) for x in leaked_items(docs, items).collect()} == {(d, i) for d in (1, 5, 6) for i in (1, 3)}
    clean = {x.doc_id: x.clean_text for x in without_leaks(docs, leak_spans(docs, items)).collect()}
    assert clean[2] is None and clean[3] == "" and clean[4] == "nothing" and clean[6] is None and clean[1] is None
    assert clean[5].split() == ["word"] * 200_000
    assert leaked_items(docs, items.limit(0)).count() == 0 and leaked_items(docs.limit(0), items).count() == 0
