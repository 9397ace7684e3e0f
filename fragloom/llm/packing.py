"""Documents put into containers of fixed capacity, with little room left over.

Linear grouping: the large pieces of a container are ranked by length and cut into groups of equal number; every length of a
group is rounded up to its greatest, so that a few sizes are left, whatever the number of documents. The best mixes of those
few sizes are found in one task for each container, from a histogram whose size the capacity bounds, to within ``cutting.GAP`` of
the least number of containers for those sizes. Then the documents are put in their places:
a piece's rank in its group says which copy of which mix it belongs to, by arithmetic alone, so no task needs to see another's
pieces. The rounding leaves some room, and into that room the small pieces go, best fit, in shards of bounded size.

Only a document longer than the capacity is split: into full containers and one rest, which is a piece like any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragloom.functions.frames import plain
from fragloom.llm.cutting import best_mixes
from fragloom.session import Scratch

GROUPS = 48
SMALL = 6  # pieces of up to 1 / SMALL of the capacity are small
SHARD = 20_000  # places and small pieces that one best-fit task takes
SALTED = 200_000  # pieces of one size that one task ranks
MAX_CAPACITY = 1_000_000


def pieces(lengths: DataFrame, targets: Sequence[tuple[str, int]]) -> DataFrame:
    """(container, capacity, doc_id, piece, size, full): what has to be placed for each container; full ones are alone in theirs."""
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("container"), F.lit(int(capacity)).cast("bigint").alias("capacity")) for name, capacity in targets]))
    rows = lengths.select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("n"), each)
    fulls, rest = F.expr("n div capacity"), F.col("n") % F.col("capacity")
    last = F.when((fulls == 0) | (rest > 0), fulls).otherwise(fulls - 1)
    out = rows.select("container", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"), fulls.alias("fulls"), rest.alias("rest"))
    full = F.col("piece") < F.col("fulls")
    return out.select("container", "capacity", "doc_id", "piece", F.when(full, F.col("capacity")).otherwise(F.col("rest")).alias("size"), full.alias("full"))


def _places(name: str, capacity: int, sizes: list[tuple[int, int]], groups: int) -> list[tuple]:
    """(container, first, last, bin, each): large pieces of rank first..last of a container go, ``each`` at a time, into bins from ``bin`` on."""
    sizes = sorted(sizes, reverse=True)
    total = sum(n for _, n in sizes)
    k = min(groups, total)
    cuts = [total * g // k for g in range(k + 1)]
    greatest, at, seen = [], 0, 0
    for first in cuts[:-1]:
        while seen + sizes[at][1] <= first:
            seen += sizes[at][1]
            at += 1
        greatest.append(sizes[at][0])
    merged: dict[int, list[int]] = {}
    for g, size in enumerate(greatest):
        merged.setdefault(size, []).append(g)
    kinds = sorted(merged, reverse=True)
    first = [cuts[merged[s][0]] for s in kinds]
    end = [cuts[merged[s][-1] + 1] for s in kinds]
    out, bin_ = [], 0
    for mix, times in best_mixes(kinds, [e - f for f, e in zip(first, end)], capacity)[0]:
        for g in mix.nonzero()[0].tolist():
            take = min(int(mix[g]) * times, end[g] - first[g])
            if take > 0:
                out.append((name, first[g], first[g] + take - 1, bin_, int(mix[g])))
                first[g] += take
        bin_ += times
    return out


def _ranked(large: DataFrame, histogram: DataFrame, salts: int) -> DataFrame:
    """Large pieces with their rank by falling size in their container; equal sizes are ranked in ``salts`` parts."""
    larger = F.sum("n").over(Window.partitionBy("container").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1))
    before = histogram.withColumn("before", F.coalesce(larger, F.lit(0))).drop("n")
    salted = large.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    parts = salted.groupBy("container", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("container", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.withColumn("inside", inside).join(before, ["container", "size"]).select("container", "size", "salt", (F.col("inside") + F.col("before")).alias("offset"))
    own = F.row_number().over(Window.partitionBy("container", "size", "salt").orderBy("doc_id", "piece")) - 1
    return salted.withColumn("own", own).join(offsets, ["container", "size", "salt"]).withColumn("rank", F.col("own") + F.col("offset")).drop("own", "offset", "salt")


def _best_fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places the small pieces of one shard in the room of its bins, each where the least remains, and opens bins where none has room."""
    pdf = plain(pdf)
    capacity, shard = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
    bins = pdf[pdf["bin"].notna()]
    room = sorted((capacity - int(s), b) for s, b in zip(bins["size"], bins["bin"]) if capacity > s)
    small = pdf[pdf["bin"].isna()].sort_values(["size", "doc_id", "piece"], ascending=[False, True, True])
    chosen, opened = [], 0
    for size in small["size"].tolist():
        i = bisect_left(room, (size, ""))
        if i == len(room):
            left, name = capacity, f"s{shard}.{opened}"
            opened += 1
        else:
            left, name = room.pop(i)
        chosen.append(name)
        if left > size:
            insort(room, (left - size, name))
    return small.assign(bin=pd.Series(chosen, index=small.index, dtype=object))[["container", "bin", "doc_id", "piece", "size"]]


def pack(lengths: DataFrame, targets: Sequence[tuple[str, int]], scratch: Scratch, groups: int = GROUPS, small: int = SMALL, shard: int = SHARD) -> DataFrame:
    """(container, bin, doc_id, piece, size): every piece of every document in one bin of each container.

    ``lengths`` has (doc_id, n_tokens), one row per document; a null or negative length counts as 0, and pieces of length 0
    are placed like any others. ``targets`` are the names and capacities, which must lie between 1 and ``MAX_CAPACITY``. The
    sizes in a bin never add up to more than the capacity; ``piece`` counts from 0 along the document. No document gives no row.
    """
    for _, capacity in targets:
        if not 1 <= capacity <= MAX_CAPACITY:
            raise ValueError(f"capacity {capacity} is not between 1 and {MAX_CAPACITY}")
    if not targets:
        raise ValueError("no container")
    todo = scratch.table(pieces(lengths, targets))
    is_large = ~F.col("full") & (F.col("size") * small > F.col("capacity"))
    large = todo.where(is_large).select("container", "capacity", "doc_id", "piece", "size")
    histogram = scratch.table(large.groupBy("container", "capacity", "size").agg(F.count(F.lit(1)).alias("n")))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        # one container's lengths and how often each occurs: at most as many rows as its capacity
        own = _places(pdf["container"].iloc[0], int(pdf["capacity"].iloc[0]), list(zip(pdf["size"].tolist(), pdf["n"].tolist())), groups)
        return pd.DataFrame(own, columns=["container", "first", "last", "base", "each"])

    table = scratch.table(histogram.groupBy("container").applyInPandas(place, "container string, first bigint, last bigint, base bigint, each bigint"))
    most = histogram.agg(F.max("n")).first()[0] or 0
    ranked = _ranked(large, histogram.drop("capacity"), max(8, -(-most // SALTED))).alias("r")
    inside = (F.col("r.container") == F.col("p.container")) & F.col("rank").between(F.col("p.first"), F.col("p.last"))
    number = F.col("base") + F.expr("(rank - first) div each")
    # the places are bounded by the square of ``groups`` for each container
    placed = ranked.join(F.broadcast(table).alias("p"), inside).select("r.container", "capacity", F.concat(F.lit("g"), number).alias("bin"), "doc_id", "piece", "size")
    placed = scratch.table(placed)

    bins = placed.groupBy("container", "capacity", "bin").agg(F.sum("size").alias("size"))
    rest = todo.where(~F.col("full") & ~is_large)
    counts = {r["container"]: r["n"] for r in rest.select("container").unionByName(bins.select("container")).groupBy("container").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards: Column = F.coalesce(*[F.when(F.col("container") == name, F.lit(-(-n // shard))) for name, n in counts.items()], F.lit(1))
    of = lambda *c: F.pmod(F.xxhash64(*c), shards)
    none = F.lit(None)
    both = bins.select("container", "capacity", of("bin").alias("shard"), "bin", none.cast("bigint").alias("doc_id"), none.cast("bigint").alias("piece"), "size").unionByName(
        rest.select("container", "capacity", of("doc_id", "piece").alias("shard"), none.cast("string").alias("bin"), "doc_id", "piece", "size")
    )
    fitted = both.groupBy("container", "shard").applyInPandas(_best_fit, "container string, bin string, doc_id bigint, piece bigint, size bigint")
    alone = todo.where("full").select("container", F.concat_ws(".", F.lit("f"), "doc_id", "piece").alias("bin"), "doc_id", "piece", "size")
    return alone.unionByName(placed.drop("capacity")).unionByName(fitted)
