"""Percentiles of very large columns per group, by deterministic collapsing of weighted sorted buffers.

A buffer is at most ``size`` sorted values, each standing for ``weight`` measurements. Collapsing takes some buffers, lays
their values side by side in order, each as often as its weight, and keeps the values at evenly spaced positions. With output
weight w that moves no rank by more than w / 2, so the error of a buffer is at most the sum of the errors collapsed into it
plus w / 2; that bound travels with the buffer as ``error``. Every task collapses its own sorted runs first, in
a tree too, so that it holds ``FAN_IN`` buffers for each level; then a tree of
fan-in ``FAN_IN`` collapses what is left, level by level, by group and node. A level adds at most n / (2 size), so a tree of
h levels is off by h / (2 size) of all ranks at most. No step draws random numbers. Groups of up to ``size`` values stay exact.

Sketches of single days or datasets are rows like any others: ``merge_sketches`` collapses them into those of coarser groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragloom.session import Scratch

SIZE = 1024
FAN_IN = 32
RUN = 64  # buffers of sorted input that a task collapses at once
PERCENTS = (5, 25, 50, 75, 95)
_BUFFER = [T.StructField("weight", T.LongType()), T.StructField("n", T.LongType()), T.StructField("error", T.DoubleType()), T.StructField("vals", T.ArrayType(T.DoubleType()))]


def collapse(vals: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The values at evenly spaced positions among the given ones, each repeated by its weight; and the weight of each."""
    order = np.argsort(vals, kind="stable")
    vals, reach = vals[order], np.cumsum(weights[order])
    total = int(reach[-1])
    weight = -(-total // size)
    if weight == 1:
        return vals, 1
    at = (np.arange(max(1, round(total / weight))) * 2 + 1) * weight / 2
    return vals[np.minimum(np.searchsorted(reach, at), len(vals) - 1)], weight


def _collapsed(buffers: list[tuple], size: int) -> tuple:
    """One (weight, n, error, vals) of several."""
    vals = np.concatenate([np.asarray(b[3], dtype=np.float64) for b in buffers])
    weights = np.concatenate([np.full(len(b[3]), b[0], dtype=np.int64) for b in buffers])
    kept, weight = collapse(vals, weights, size)
    return weight, sum(b[1] for b in buffers), sum(b[2] for b in buffers) + (weight / 2 if weight > 1 else 0), kept


def _leaf(keys: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, head = TaskContext.get().partitionId(), [], None
        levels: list[list[tuple]] = []

        def close() -> None:
            vals = np.concatenate(held)
            held.clear()
            kept, weight = collapse(vals, np.ones(len(vals), dtype=np.int64), size)
            new, level = (weight, len(vals), weight / 2 if weight > 1 else 0.0, kept), 0
            while True:
                if level == len(levels):
                    levels.append([])
                levels[level].append(new)
                if len(levels[level]) < FAN_IN:
                    return
                new, level = _collapsed(levels[level], size), level + 1
                levels[level - 1].clear()

        def finish(rows: list) -> None:
            if held:
                close()
            rows += [(head, *b) for own in levels for b in own]
            levels.clear()

        def table(rows: list) -> pa.RecordBatch:
            first = pa.Table.from_batches([r[0] for r in rows]).combine_chunks()
            names = [*[f"k{i}" for i in range(keys)], "part", "weight", "n", "error", "vals"]
            ends = np.cumsum([0, *[len(r[4]) for r in rows]])
            vals = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r[4] for r in rows])))
            cols = [*[first.column(i).combine_chunks() for i in range(keys)], pa.array([part] * len(rows), pa.int64())]
            cols += [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()))]
            return pa.RecordBatch.from_arrays([*[c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in cols], vals], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, dtype=bool)
            for i in range(keys):
                ids = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                codes[1:] |= ids[1:] != ids[:-1]
            values = batch.column(keys).to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(codes).tolist(), batch.num_rows]
            rows: list = []
            for a, b in zip(cuts, cuts[1:]):
                own = batch.slice(a, 1).select(list(range(keys)))
                if head is not None and (a or not own.equals(head)):
                    finish(rows)
                head = own
                held.append(values[a:b])
                if sum(map(len, held)) >= RUN * size:
                    close()
            if rows:
                yield table(rows)
        if head is not None:
            rows = []
            finish(rows)
            if rows:
                yield table(rows)

    return run


def _merge(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            out = []
            for some in parts.to_pylist():
                own = [(p["weight"], p["n"], p["error"], p["vals"]) for p in some]
                out.append(own[0] if len(own) == 1 else _collapsed(own, size))
            keep = [i for i, name in enumerate(batch.schema.names) if name != "parts"]
            cols = [batch.column(i) for i in keep] + [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, [*[batch.schema.names[i] for i in keep], "weight", "n", "error", "vals"])

    return run


def _tree(buffers: DataFrame, keys: Sequence[str], width: int, size: int) -> DataFrame:
    """Collapses the buffers of each group, whose ``node`` numbers are below ``width``, into one; a task sees those of one node."""
    while True:
        width = -(-width // FAN_IN)
        grouped = buffers.groupBy(*keys, F.expr(f"node div {FAN_IN}").alias("node")).agg(F.collect_list(F.struct("weight", "n", "error", "vals")).alias("parts"))
        schema = T.StructType([*[f for f in grouped.schema if f.name != "parts"], *_BUFFER])
        buffers = grouped.mapInArrow(_merge(size), schema)
        if width == 1:
            return buffers.drop("node")


def percentile_sketches(df: DataFrame, by: Sequence[str], value: str, scratch: Scratch, size: int = SIZE) -> DataFrame:
    """(by, weight, n, error, vals): one buffer per group over all its values that are neither null nor NaN.

    A null group value is a group; a group without values has no row. Other columns of ``df`` are not read.
    """
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    leaf_schema = T.StructType([*[f for f in rows.schema if f.name != "v"], T.StructField("part", T.LongType()), *_BUFFER])
    leaves = scratch.table(rows.sortWithinPartitions(*keys, "v").mapInArrow(_leaf(len(keys), size), leaf_schema))
    width = (leaves.agg(F.max("part")).first()[0] or 0) + 1
    merged = _tree(leaves.withColumnRenamed("part", "node"), keys, width, size)
    return merged.withColumnsRenamed(dict(zip(keys, by)))


def merge_sketches(sketches: DataFrame, by: Sequence[str], size: int = SIZE) -> DataFrame:
    """Sketches of finer groups collapsed into those of ``by``, some of their columns; the result is a sketch again."""
    keys = [f"k{i}" for i in range(len(by))]
    fine = [c for c in sketches.columns if c not in {"weight", "n", "error", "vals"}]
    written = Scratch(sketches.sparkSession, "sketches").table(sketches.withColumn("_row", F.monotonically_increasing_id()))
    # numbered without their values
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*fine, "_row")) - 1
    numbers = written.select(*fine, "_row").withColumn("node", number.cast("bigint")).select("_row", "node")
    most = (numbers.agg(F.max("node")).first()[0] or 0) + 1
    rows = written.join(numbers, "_row").select(*[F.col(c).alias(k) for c, k in zip(by, keys)], "node", "weight", "n", "error", "vals")
    return _tree(rows, keys, most, size).withColumnsRenamed(dict(zip(keys, by)))


def percentiles(sketches: DataFrame, percents: Sequence[int] = PERCENTS) -> DataFrame:
    """The groups with n, p<percent> for each percent, and ``max_rank_error``.

    The percentile p of n values is the one of rank ceil(n p / 100), at least 1; the value given has a rank that is at most
    ``max_rank_error`` away from it.
    """
    groups = [c for c in sketches.columns if c not in {"weight", "n", "error", "vals"}]
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.col("n") * p / 100))
    pick = lambda p: F.element_at("vals", (F.least(F.size("vals"), F.floor((rank(p) - 1) / F.col("weight")) + 1)).cast("int"))
    return sketches.select(*groups, "n", *[pick(p).alias(f"p{p:02d}") for p in percents], F.ceil("error").alias("max_rank_error"))
