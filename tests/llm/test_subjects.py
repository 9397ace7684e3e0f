import random

import numpy as np
from pyspark.sql import functions as F

from fragloom.llm.subjects import body, document_subjects, singular_vectors, vocabulary
from fragloom.session import Scratch

ITEMS = "item_id bigint, prompt string, solution string"
LETTERS = "abcdefghij"
TOPICS = {s: [f"{s}{a}{b}" for a in LETTERS for b in LETTERS] for s in ("sea", "sky")}
NOISE = [f"noise{a}{b}{c}" for a in LETTERS for b in LETTERS for c in "kl"]


def corpus(n, seed=0):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        own = r.choice([["sea"], ["sky"], ["sea", "sky"], []])
        names = [w for s in own for w in r.choices(TOPICS[s], k=8)]
        names += r.choices(NOISE, k=6)
        r.shuffle(names)
        rows.append((i, "\n".join(f"def {a}_{b.title()}(x):  # common words here" for a, b in zip(names, names[1:]))))
        labels += [(i, s) for s in own]
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "seaaa seaab"), (1002, " ".join(TOPICS["sea"] * 1_000)), rows[3]], "doc_id bigint, text string").withColumn("subject", F.lit("clash"))
    seeds = spark.createDataFrame([x for x in labels if x[0] < 150] + [(None, "sea"), (5, None), (7, "unknown"), (99999, "sky"), labels[0]], "doc_id bigint, subject string")
    got = {tuple(x) for x in document_subjects(docs, seeds, ["sea", "sky"], spark.createDataFrame([], ITEMS), Scratch(spark, "t")).collect()}
    want = {x for x in labels if x[0] >= 150}
    mine = {x for x in got if 150 <= x[0] < 600}
    assert len(mine & want) >= 0.97 * max(len(mine), len(want))
    assert not {x for x in got if x[0] in (1000, 1001)} and (1002, "sea") in got


def test_a_subject_of_a_third_of_all_documents_keeps_its_terms(spark):
    r = random.Random(3)
    own = {"sea": [f"sea{a}{b}" for a in LETTERS for b in "kl"], "sky": [f"sky{a}{b}" for a in LETTERS for b in LETTERS]}
    rows, labels = [], []
    for i in range(600):
        s = "sea" if i % 3 == 0 else "sky" if i % 10 == 1 else None
        names = (r.choices(own[s], k=8) if s else []) + r.choices(NOISE, k=6)
        r.shuffle(names)
        rows.append((i, "\n".join(f"def {a}(x):  # common words here" for a in names)))
        labels += [(i, s)] if s else []
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seeds = spark.createDataFrame([x for x in labels if x[0] < 200], "doc_id bigint, subject string")
    got = {tuple(x) for x in document_subjects(docs, seeds, ["sea", "sky"], spark.createDataFrame([], ITEMS), Scratch(spark, "t")).collect()}
    want, mine = {x for x in labels if x[0] >= 200}, {x for x in got if x[0] >= 200}
    assert len(mine & want) >= 0.97 * max(len(mine), len(want))


def test_terms_are_counted_by_distinct_documents(spark):
    rows = [(i, ["thread", "threads"] if i < 4 else ["thread"] if i < 6 else ["the", "rest"]) for i in range(200)]
    labels = spark.createDataFrame([(i, [0 if i < 6 else 1]) for i in (0, 1, 2, 50, 51, 52)], "doc_id bigint, labels array<int>")
    number, freq = vocabulary(spark.createDataFrame(rows, "doc_id bigint, terms array<string>"), 200, labels)
    assert number["thread"] == number["threads"] and freq[number["thread"]] == 6


def test_no_seeds_no_documents(spark):
    rows, _ = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    none, items = spark.createDataFrame([], "doc_id bigint, subject string"), spark.createDataFrame([], ITEMS)
    assert document_subjects(docs, none, ["sea"], items, Scratch(spark, "t")).count() == 0
    assert document_subjects(docs.limit(0), none, ["sea"], items, Scratch(spark, "t")).count() == 0


def test_body_leaves_out_notes():
    text = "// Copyright 2020 x. Use is free under a licence,\n// in any court.\n\n# generated by y; do not edit\n\n// copied from a/b.c\nint court;\n"
    assert body(text) == "\nint court;\n"
    assert body("# plain comment\nx = 1") == "# plain comment\nx = 1"
    assert body("<!-- licence\n<!-- of x\n<b>sea</b>") == "<b>sea</b>"
    assert body("") == "" and body("\n\n") == "\n\n"


def test_body_keeps_texts_that_only_contain_such_words():
    rows = "".join(f'  {{"isotope": {i}, "memo": "taxonomy of the enzyme"}},\n' for i in range(50))
    json = rows + '  {"rightSpecimen": 1, "generated": "license of the orbit", "memo": "all rights reserved"}'
    html = "<section>\n  <p>the oven is generated by a license, do not change</p>\n</section>"
    mini = "!function(){const right=1;/* see the rights and licence notes */const generated='Copyright 2020';return copyright(right)}()"
    for text in (json, html, mini, "generatedKitchen = 1", "def license_court(x):\n  return x"):
        assert body(text) == text


def test_body_takes_only_the_note_before_a_text_without_empty_lines():
    terms = "This file belongs to x-1. Use is free under the Greenbank\nPublic Terms 1.1; a party that brings a claim\nloses the rights granted here. See the licence file for the governing law and the full list of\nconditions.\n"
    rows = '  {"court": "serve paddle"},\n  {"right": "hurdle"}\n'
    assert body(terms + rows) == rows and body(terms + "\n" + rows) == "\n" + rows
    assert body("@generated\n<p>sea</p>\n<p>sky</p>") == "<p>sea</p>\n<p>sky</p>"
    assert body("machine-written by stubgrinder 5.0; do not change\n<p>sea</p>") == "<p>sea</p>"
    assert body("# @generated\n# a tide with two seas\nsea = 1") == "# a tide with two seas\nsea = 1"
    assert body("machine-written by stubgrinder 5.0; do not change !function(){sea()}()").strip() == "!function(){sea()}()"
    assert body("/* Copyright 2020 x. All rights reserved. */!function(){sea()}()") == "!function(){sea()}()"
    assert body("\ufeff// Copyright 2020 x\n// in any court\nsea()") == "sea()"
    long = "const sea='" + "tide " * 60 + "';/* copied from lib/oven.js */sky()"
    assert body(long).startswith("const sea=") and body(long).endswith("sky()") and "oven" not in body(long)


def test_singular_vectors_match_a_dense_decomposition(spark):
    rng = np.random.default_rng(0)
    rows, dense, scale = [], np.zeros((80, 20)), rng.random(20) + 0.5
    for i in range(80):
        ids = sorted(rng.choice(20, 5, replace=False).tolist())
        tf = rng.integers(1, 4, 5).tolist()
        rows.append((i, ids, tf, None))
        log = 1 + np.log(tf)
        dense[i, ids] = log * scale[ids] / np.sqrt(log.sum())
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<int>, tf array<int>, labels array<int>")
    basis = singular_vectors(df, scale, 20)
    _, _, vt = np.linalg.svd(dense, full_matrices=False)
    assert abs(abs(basis[:, 0] @ vt[0]) - 1) < 1e-4 and abs(abs(basis[:, 1] @ vt[1]) - 1) < 1e-3


def test_sums_of_many_tasks_are_added_in_a_tree(spark, monkeypatch):
    from fragloom.llm import subjects

    monkeypatch.setattr(subjects, "_FAN_IN", 3)

    def each(batch, out):
        for row in batch.column(0).to_pylist():
            out[row % out.shape[0]] += row

    rows = spark.range(0, 5_000, 1, 20)
    want = np.zeros((2_500, 2)) + (np.arange(2_500) * 2 + 2_500)[:, None]
    assert (subjects._added_up(rows, (2_500, 2), each) == want).all()
    assert (subjects._added_up(rows.where("id < 0"), (2_500, 2), each) == 0).all()
