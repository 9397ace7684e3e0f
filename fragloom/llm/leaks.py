"""Documents that hold passages of test items, word for word or nearly so, and the texts without those passages.

A passage is a stretch of at least ``length`` successive words of a part of an item with at most one word in ``one_in`` changed,
added or left out. A stretch of twice that length or more has a half that is a passage too, so only those below that are looked
for, and longer ones are put together from them. Each has a run of ``least_run`` untouched words or more (8 for 40 and 10).

1. One pass over the corpus, however many items there are, keeps the texts with a run that may be an item's (``runs``); their
   runs are joined with the items' runs, which gives the (text, block of items) that have one in common.
2. The items of a block, of about ``BLOCK_WORDS`` words, become one suffix automaton in the tasks that hold that block's texts.
   Each text streams through it, and the places where it is ``least_run`` words deep are all that can be part of a passage.
3. The words around each such place are aligned with the item's, in windows of a fixed size, so that neither a long item nor a
   long text takes more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.llm.automaton import SuffixAutomaton, words
from fragloom.llm.runs import WordNumbers, item_parts, item_runs, run_filter
from fragloom.session import Scratch

LENGTH, ONE_IN = 40, 10
BLOCK_WORDS = 200_000  # words of test items in one automaton
SHARE = 1_000_000  # characters of text that one automaton is built for; a block with more is built in several tasks
_PARTS = 20_000  # partitions of the aligning stage at most
_BATCH = 1024  # windows aligned side by side


def least_run(length: int = LENGTH, one_in: int = ONE_IN) -> int:
    """Untouched words in a row that every passage has."""
    return min(-(-(n - n // one_in) // (n // one_in + 1)) for n in range(length, 2 * length))


def stretches(items: np.ndarray, windows: np.ndarray, band: int, length: int, one_in: int) -> list[tuple[int, int, int]]:
    """(row, first, last): the stretches of ``windows`` that are passages of the ``items`` of the same row, from the first to the last untouched word.

    ``windows[c, i + b]`` is the text's word at diagonal b of the band for the item's word i; -1 is no known word there and -2 no
    word of the item. best[e] holds, for each diagonal, the longest stretch of the item that ends at its current word with e
    words touched, and on which diagonal it began: ``length * base + diagonal``.
    """
    rows, width = items.shape
    most = (2 * length - 1) // one_in
    base = 1 << (band - 1).bit_length()
    begin = np.arange(band, dtype=np.int32)
    best = np.broadcast_to(begin, (most + 1, rows, band)).copy()
    need = np.array([max(length, e * one_in) for e in range(most + 1)])[:, None, None] * base
    change = np.zeros((rows, windows.shape[1] + 1), dtype=np.int32)
    same = np.zeros(windows.shape, dtype=bool)
    for i in range(width):
        equal = windows[:, i : i + band] == items[:, i : i + 1]
        same[:, i : i + band] |= equal
        new = np.where(equal[None], best + base, begin)
        for e in range(1, most + 1):
            row, before = new[e], best[e - 1] + base
            np.maximum(row, before, out=row)  # changed
            np.maximum(row[:, :-1], before[:, 1:], out=row[:, :-1])  # left out of the text
            np.maximum(row[:, 1:], new[e - 1][:, :-1], out=row[:, 1:])  # added in the text
        new[:, items[:, i] < 0] = begin
        best = new
        if i + 1 >= length:
            passing = best >= need
            at = np.flatnonzero(passing.any(axis=(0, 2)))
            if len(at):
                own = best[:, at]
                first = i + 1 - own // base + own % base
                first = np.where(passing[:, at], first, windows.shape[1]).min(axis=(0, 2))
                last = i + np.where(passing[:, at], begin, -1).max(axis=(0, 2))
                np.add.at(change, (at, np.maximum(first, 0)), 1)
                np.add.at(change, (at, last + 1), -1)
    covered = np.cumsum(change, axis=1)[:, :-1] > 0
    out = []
    for c in np.flatnonzero(covered.any(axis=1)).tolist():
        edges = np.flatnonzero(np.diff(covered[c].astype(np.int8), prepend=0, append=0))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            untouched = np.flatnonzero(same[c, a:b])
            if len(untouched):
                out.append((c, a + int(untouched[0]), a + int(untouched[-1])))
    return out


class LeakFinder:
    """The passages of one block of test items, given as (item, part, text), in texts."""

    def __init__(self, parts: list[tuple[int, str, str]], length: int = LENGTH, one_in: int = ONE_IN):
        self.length, self.one_in = length, one_in
        self.least = least_run(length, one_in)
        self.items = [(item, part) for item, part, _ in parts]
        self.automaton = SuffixAutomaton([words(text) for _, _, text in parts], self.least)
        self.reach = (2 * length - 1) // one_in + 1
        self.chunk = 2 * length

    def find(self, texts: list[str | None]) -> list[tuple[int, int, str, int, int]]:
        """(position of the text, item, part, first word, last word): passages from their first to their last untouched word; those that overlap are one."""
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        todo: list[tuple] = []
        a = self.automaton
        for at, text in enumerate(texts):
            if not text:
                continue
            ids = a.ids(words(text))
            j, end = a.seeds(ids)
            if not len(j):
                continue
            part = np.searchsorted(a.starts, end, side="right") - 1
            place = end - a.starts[part]
            # a passage around a seed lies within one chunk of the item before the seed's and one after it, and drifts by less than ``reach``
            keys = np.unique(np.stack([part, place // self.chunk, (j - place) // self.reach], axis=1), axis=0)
            for p, c, d in keys.tolist():
                todo.append((at, p, ids, (c - 1) * self.chunk, (d - 1) * self.reach))
                if len(todo) == _BATCH:
                    self._align(todo, spans)
                    todo = []
        self._align(todo, spans)
        out = []
        for (at, p), own in sorted(spans.items()):
            first, last = None, -1
            for lo, hi in sorted(own):
                if first is not None and lo > last + 1:
                    out.append((at, *self.items[p], first, last))
                    first = None
                first, last = (lo, hi) if first is None else (first, max(last, hi))
            out.append((at, *self.items[p], first, last))
        return out

    def _align(self, todo: list[tuple], spans: dict[tuple[int, int], list[tuple[int, int]]]) -> None:
        """Adds the passages in the windows (text, part, its words, first word of the item, first diagonal)."""
        if not todo:
            return
        width, band = 3 * self.chunk, 3 * self.reach
        items = np.full((len(todo), width), -2, dtype=np.int32)
        windows = np.full((len(todo), width + band), -1, dtype=np.int32)
        for c, (_, p, ids, start, diagonal) in enumerate(todo):
            for target, source, low in ((items, self.automaton.texts[p], start), (windows, ids, start + diagonal)):
                a, b = max(0, low), min(len(source), low + target.shape[1])
                if b > a:
                    target[c, a - low : b - low] = source[a:b]
        # any passage has ``length`` words in a row of which all but ``reach`` - 1 occur near their diagonals; most windows don't
        near = np.zeros(items.shape, dtype=np.int32)
        for b in range(band):
            near |= windows[:, b : b + width] == items
        upto = np.cumsum(near, axis=1)
        most = (upto[:, self.length - 1 :] - np.pad(upto, ((0, 0), (1, 0)))[:, : width - self.length + 1]).max(axis=1)
        kept = np.flatnonzero(most > self.length - self.reach)
        for c, first, last in stretches(items[kept], windows[kept], band, self.length, self.one_in):
            at, p, _, start, diagonal = todo[kept[c]]
            spans.setdefault((at, p), []).append((start + diagonal + first, start + diagonal + last))


def leak_spans(documents: DataFrame, items: DataFrame, length: int = LENGTH, one_in: int = ONE_IN, block_words: int = BLOCK_WORDS, share: int = SHARE) -> DataFrame:
    """(doc_id, item_id, part, first_word, last_word) of every passage of ``items`` (item_id, prompt, solution) in ``documents`` (doc_id, text).

    Null and empty texts and parts hold nothing; parts shorter than ``length`` words can't leak, and documents and items without
    an id are left out. Repeated documents and items give their rows once; an item that occurs twice in a text gives two. No
    item or no document gives no row. Other columns are not read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    least = least_run(length, one_in)
    parts = scratch.table(item_parts(items))
    runs = scratch.table(item_runs(parts, least))
    total = runs.agg(F.sum("n_words")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")
    of_block = runs.select(block, F.explode("runs").alias("run")).distinct()
    sent = spark.sparkContext.broadcast(run_filter(of_block.select("run").distinct(), least))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, known = WordNumbers(), sent.value
        for batch in batches:
            own = [list(map(numbers.__getitem__, words(text))) for text in batch.column(1).to_pylist()]
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            text, _, runs = known.hits(np.fromiter(chain.from_iterable(own), np.uint64, int(lengths.sum())), lengths)
            keep, first = np.unique(text, return_index=True)
            kept = pa.array(keep, pa.int64())
            found = pa.array([np.unique(x) for x in np.split(runs, first[1:])] if len(keep) else [], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), found], ["doc_id", "text", "runs"])

    texts = documents.where("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    held = scratch.table(texts.mapInArrow(suspects, "doc_id bigint, text string, runs array<bigint>").withColumn("row", F.monotonically_increasing_id()))
    pairs = held.select("row", F.explode("runs").alias("run")).join(of_block.hint("merge"), "run").select("row", "block").distinct()
    todo = scratch.table(held.drop("runs").join(pairs.hint("merge"), "row").select("block", "row", "doc_id", "text"))
    tasks = scratch.table(todo.groupBy("block").agg(F.ceil(F.sum(F.length("text")) / share).alias("tasks")))
    n = max(1, min(_PARTS, 4 * (tasks.agg(F.sum("tasks")).first()[0] or 1)))
    left = todo.join(tasks, "block").select("block", F.pmod(F.xxhash64("row"), F.col("tasks")).alias("task"), "doc_id", "text")
    right = parts.select(block, "item_id", "part", "text").join(tasks, "block").select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)).alias("task"), "item_id", "part", "text")
    names = ["doc_id", "item_id", "part", "first_word", "last_word"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def find(texts: pa.Table, own: pa.Table) -> pa.Table:
        if not texts.num_rows or not own.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        parts = sorted(zip(own.column("item_id").to_pylist(), own.column("part").to_pylist(), own.column("text").to_pylist()))
        ids = texts.column("doc_id").to_pylist()
        found = LeakFinder(parts, length, one_in).find(texts.column("text").to_pylist())
        cols = list(zip(*[(ids[at], *rest) for at, *rest in found])) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    # the texts are few but take long, so their groups are not put together into fewer tasks
    left, right = (x.repartition(n, "block", "task") for x in (left, right))
    spans = left.groupBy("block", "task").cogroup(right.groupBy("block", "task")).applyInArrow(find, "doc_id bigint, item_id bigint, part string, first_word bigint, last_word bigint")
    return spans.distinct()


def leaked_items(documents: DataFrame, items: DataFrame, length: int = LENGTH, one_in: int = ONE_IN) -> DataFrame:
    """(doc_id, item_id): the items of which a document holds a passage."""
    return leak_spans(documents, items, length, one_in).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, spans: DataFrame, coverage: float = 0.5) -> DataFrame:
    """``documents`` with ``clean_text``: the text without its spans, or null where they cover at least ``coverage`` of its words.

    Spans may overlap and repeat. A document with a null text keeps null; one without spans keeps its text as it is.
    """
    per = spans.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "last_word")).alias("_spans"))

    @F.pandas_udf("string")
    def cut(texts, spans):  # type: ignore[no-untyped-def]
        import re

        import pandas as pd

        word = re.compile(r"[^\W_]+")

        def one(text, own):
            if text is None or own is None:
                return text
            at = [m.span() for m in word.finditer(text)]
            out, last, gone = [], 0, 0
            for a, b in sorted((s["first_word"], s["last_word"]) for s in own):
                lo, hi = at[a][0], at[b][1]
                if hi <= last:
                    continue
                out.append(text[last:lo] if lo > last else "")
                gone += sum(1 for x, _ in at[a : b + 1] if x >= last)
                last = hi
            return None if gone >= coverage * len(at) else "".join(out) + text[last:]

        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    joined = documents.alias("d").join(per.alias("s"), F.col("d.doc_id") == F.col("s.doc_id"), "left")
    return joined.select("d.*", F.when(F.col("s._spans").isNull(), F.col("d.text")).otherwise(cut("d.text", "s._spans")).alias("clean_text"))
