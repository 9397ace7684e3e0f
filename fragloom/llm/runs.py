"""Runs of successive words of test items as numbers, and a filter of bounded size that tells which texts may hold one.

A run is a 64-bit number made of its words, so equal runs have equal numbers wherever they are made. The filter is a table of
at most ``MOST_BITS`` bits, whatever the number of items: with more items it lets more texts pass, and never holds one back.
What passes is joined with the items' runs on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.llm.automaton import words

MOST_BITS, LEAST_BITS = 1 << 26, 1 << 16  # 8 MB and 8 kB
_PER_RUN = 64  # bits of the filter for each run, while there are few
_PROBES = (0, 12, 25, 38)  # where in a run's number the places of its bits are read
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd constants
_KEPT = 500_000  # words whose numbers a task keeps


class WordNumbers(dict):
    """A number for each word, made when the word is first seen."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        self[word] = out = crc32(word.encode("utf-8", "surrogatepass"))
        return out


def run_numbers(codes: np.ndarray, least: int) -> np.ndarray:
    """The number of each run of ``least`` words, by its first word; ``codes`` are the words' numbers."""
    n = len(codes) - least + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(least):
        out = out * _STEP + codes[k : k + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return (out ^ (out >> np.uint64(29))).view(np.int64)


class RunFilter:
    """Which runs may be among those of the items."""

    def __init__(self, bits: int, least: int, table: np.ndarray):
        self.mask, self.least, self.table = np.int64(bits - 1), least, table

    def hits(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word in it, number) of the runs that may be an item's, in texts whose words' numbers follow each other in ``codes``."""
        runs = run_numbers(codes, self.least)
        at = np.arange(len(runs))
        for shift in _PROBES:
            slot = (runs[at] >> shift) & self.mask
            at = at[(self.table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)]
        ends = np.cumsum(lengths)
        text = np.searchsorted(ends, at, side="right")
        inside = at + self.least <= ends[text] if len(at) else np.zeros(0, dtype=bool)
        text, at = text[inside], at[inside]
        return text, at - (ends - lengths)[text], runs[at]


def item_parts(items: DataFrame) -> DataFrame:
    """(item_id, part, text): the distinct prompts and solutions that are not empty, of items with an id."""
    part = lambda c: F.struct(F.lit(c).alias("part"), F.col(c).alias("text"))
    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.inline(F.array(part("prompt"), part("solution"))))
    return rows.where("text <> ''").distinct()


def item_runs(parts: DataFrame, least: int) -> DataFrame:
    """(item_id, n_words, runs) of every part."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            n, runs = [], []
            for text in batch.column(1).to_pylist():
                own = words(text)
                n.append(len(own))
                runs.append(np.unique(run_numbers(np.fromiter(map(numbers.__getitem__, own), np.uint64, len(own)), least)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], ["item_id", "n_words", "runs"])

    return parts.select("item_id", "text").mapInArrow(make, "item_id bigint, n_words bigint, runs array<bigint>")


def run_filter(runs: DataFrame, least: int) -> RunFilter:
    """The filter over ``runs`` (run); the driver gets its words, of which there are ``MOST_BITS`` / 32 at most."""
    n = runs.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n * _PER_RUN):
        bits *= 2
    slots = runs.select(F.explode(F.array(*[F.shiftright("run", shift).bitwiseAND(F.lit(bits - 1)) for shift in _PROBES])).alias("slot"))
    filled = slots.select(F.shiftright("slot", 5).alias("word"), F.expr("shiftleft(1L, int(slot & 31))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(bits // 32, dtype="<u4")
    for row in filled.toLocalIterator():
        table[row["word"]] = row["bits"]
    return RunFilter(bits, least, table.view(np.uint8))
