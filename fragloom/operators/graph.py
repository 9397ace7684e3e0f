"""Events as graphs: breakends are nodes, breakpoints and facing breakends are edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.functions.frames import plain
from fragloom.functions.stats import fisher_greater
from fragloom.functions.text import facing
from fragloom.operators.components import components
from fragloom.operators.rangejoin import overlap_join
from fragloom.operators.readclouds import number_clouds
from fragloom.operators.support import breakends
from fragloom.operators.tips import Tips
from fragloom.session import Scratch


def node_key(chrom: str, pos: str, orientation):  # type: ignore[no-untyped-def]
    return F.concat_ws(":", chrom, F.format_string("%012d", pos), orientation)


def event_positions(events: DataFrame) -> DataFrame:
    """(chrom, pos, orientation, assembled): the distinct ends of events, x and y stacked."""
    end = lambda s, i: F.struct(F.col(f"chrom{s}").alias("chrom"), F.col(s).alias("pos"), F.substring("orientation", i, 1).alias("orientation"), F.col("assembled"))
    return events.select(F.inline(F.array(end("x", 1), end("y", 2)))).where("chrom IS NOT NULL AND pos IS NOT NULL").distinct()


def precluster(positions: DataFrame, gap: int = 3_000) -> DataFrame:
    """(chrom, pos, clustered): every distinct position with the mean, cut to a whole number, of its run; a run breaks at a gap of more than ``gap``."""
    distinct = positions.select("chrom", "pos").distinct().select("chrom", "pos", F.col("pos").alias("ref_end"), F.lit(0).alias("read_id"))
    runs = number_clouds(distinct, ["chrom"], gap)
    means = runs.groupBy("chrom", "cloud").agg(F.floor(F.avg("pos")).cast("bigint").alias("clustered"))
    return runs.join(means, ["chrom", "cloud"]).select("chrom", "pos", "clustered")


def with_clustered(events: DataFrame, clustered: DataFrame) -> DataFrame:
    """``events`` with x and y at the mean of their runs, from ``precluster``, and what they were as ``original_x`` and ``original_y``; an unknown side stays null."""
    of = lambda s: clustered.select(F.col("chrom").alias(f"chrom{s}"), F.col("pos").alias(s), F.col("clustered").alias(f"_{s}"))
    both = events.join(of("x"), ["chromx", "x"], "left").join(of("y"), ["chromy", "y"], "left")
    return both.withColumnsRenamed({"x": "original_x", "y": "original_y"}).withColumnsRenamed({"_x": "x", "_y": "y"})


def merge_breakends(positions: DataFrame, gap: int = 5_000) -> DataFrame:
    """(chrom, pos, orientation, assembled): runs of one orientation brought down to their assembled positions, or else to their mean."""
    rows = positions.select("chrom", "orientation", "pos", F.coalesce("assembled", F.lit(False)).alias("assembled")).distinct()
    runs = number_clouds(rows.withColumns({"ref_end": F.col("pos"), "read_id": F.col("assembled").cast("int")}), ["chrom", "orientation"], gap)
    means = runs.groupBy("chrom", "orientation", "cloud").agg(F.max("assembled").alias("any_assembled"), F.floor(F.avg("pos")).cast("bigint").alias("mean"))
    kept = runs.where("assembled").select("chrom", "pos", "orientation", "assembled")
    return kept.unionByName(means.where("NOT any_assembled").select("chrom", F.col("mean").alias("pos"), "orientation", F.lit(False).alias("assembled")))


def build_graph(events: DataFrame, max_p: float = 1e-4, min_total: int = 20, min_ratio: float = 0.01, min_shared: int = 20, order: str = "event_id") -> DataFrame:
    """(u, v, event_id, ratio and the event's columns): the edges that pass; of several between the same breakends the last by ``order``.

    A null p passes. Only ends that are no facing pair make an edge; a missing side makes none.
    """
    ox, oy = F.substring("orientation", 1, 1), F.substring("orientation", 2, 1)
    known = events.where("x IS NOT NULL AND y IS NOT NULL AND chromx IS NOT NULL AND chromy IS NOT NULL")
    passing = known.where((F.col("p").isNull() | (F.col("p") <= max_p)) & (F.col("total") >= min_total) & (F.col("shared") >= min_shared) & (F.col("shared") >= F.col("total") * min_ratio))
    apart = passing.where(facing(F.col("chromx"), F.col("x"), ox, F.col("chromy"), F.col("y"), oy) == "breakpoint")
    a, b = node_key("chromx", "x", ox), node_key("chromy", "y", oy)
    keyed = apart.withColumns({"u": F.least(a, b), "v": F.greatest(a, b), "ratio": F.col("shared") / F.col("total")})
    others = [c for c in keyed.columns if c not in ("u", "v")]
    return keyed.groupBy("u", "v").agg(F.max_by(F.struct(*others), F.col(order)).alias("_e")).select("u", "v", "_e.*")


def _one_after_the_other(pdf: pd.DataFrame) -> pd.DataFrame:
    """(u, v) of the edges (u, v, w) that are taken when the best comes first and drops all others at its nodes."""
    own = plain(pdf).sort_values(["w", "u", "v"], ascending=False)
    used: set[str] = set()
    keep = []
    for u, v in zip(own["u"], own["v"]):
        keep.append(u not in used and v not in used)
        if keep[-1]:
            used.update((u, v))
    return own.loc[keep, ["u", "v"]]


def best_edges(edges: DataFrame, scratch: Scratch, weight: str = "ratio", rounds: int = 5, most: int = 200_000) -> DataFrame:
    """The edges left when the one with the greatest ``weight`` is taken again and again and the others at its two nodes are dropped.

    In every round all edges that are the best at both of their nodes are taken at once, which gives the same edges. That takes
    one round for each step of a chain of falling weights; so after ``rounds`` of them, what is left is cut into its connected
    parts: each of up to ``most`` edges is gone through in one task, and of larger ones the ``most`` heaviest edges, on which no
    other edge has a say. That is repeated until no edge is left, so none is lost, however long a chain is. Equal weights are
    decided by the nodes' keys; a null weight is below all others. Edges with a null end are left out.
    """
    slim = edges.where("u IS NOT NULL AND v IS NOT NULL").groupBy("u", "v").agg(F.coalesce(F.max(F.col(weight).cast("double")), F.lit(float("-inf"))).alias("w"))
    count = F.count(F.lit(1)).alias("n")
    left, seen = scratch.measured(slim, count)
    taken: list[DataFrame] = []

    def take(chosen: DataFrame) -> None:
        nonlocal left, seen
        taken.append(scratch.table(chosen))
        nodes = taken[-1].select(F.explode(F.array("u", "v")).alias("node")).distinct()
        before = left
        rest = left.join(nodes, left["u"] == nodes["node"], "left_anti").join(nodes, F.col("v") == nodes["node"], "left_anti")
        left, seen = scratch.measured(rest, count)
        scratch.drop(before)

    while seen["n"]:
        for _ in range(rounds):
            best = left.select(F.explode(F.array("u", "v")).alias("node"), F.struct("w", "u", "v").alias("r")).groupBy("node").agg(F.max("r").alias("r"))
            take(best.groupBy("r").agg(F.count(F.lit(1)).alias("ends")).where("ends = 2 OR r.u = r.v").select(F.col("r.u").alias("u"), F.col("r.v").alias("v")))
            if not seen["n"]:
                break
        else:
            of = components(left.select("u", "v"), scratch).select(F.col("node").alias("u"), "component")
            parts, held = scratch.measured(left.join(of, "u").groupBy("component").agg(F.count(F.lit(1)).alias("size")), F.max("size").alias("most"))
            marked = left.join(of, "u").join(parts, "component")
            small = marked.where(F.col("size") <= most).select(F.col("component").alias("part"), "u", "v", "w")
            if held["most"] > most:
                heaviest = marked.where(F.col("size") > most).orderBy(F.desc("w"), F.desc("u"), F.desc("v")).limit(most)
                small = small.unionByName(heaviest.select(F.lit("").alias("part"), "u", "v", "w"))
            take(small.groupBy("part").applyInPandas(lambda pdf: _one_after_the_other(pdf[["u", "v", "w"]]), "u string, v string"))
    chosen = slim.select("u", "v").limit(0)
    for part in taken:
        chosen = chosen.unionByName(part)
    return edges.join(chosen, ["u", "v"], "left_semi")


def prefer_assembled(edges: DataFrame, assembled: DataFrame, scratch: Scratch, min_ratio: float = 0.05, min_shared: int = 10) -> DataFrame:
    """``edges`` where an assembled one, (u, v, order) in ``assembled``, drops all others at its nodes; earlier ones by ``order`` first."""
    known = edges.join(assembled, ["u", "v"]).where((F.col("ratio") >= min_ratio) & (F.col("shared") >= min_shared)).withColumn("_first", -F.col("order"))
    first = scratch.table(best_edges(known.select("u", "v", "_first"), scratch, "_first").select("u", "v", F.lit(True).alias("_chosen")))
    nodes = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    marked = edges.join(first, ["u", "v"], "left")
    free = marked.where("_chosen IS NULL").join(nodes, F.col("u") == nodes["node"], "left_anti").join(nodes, F.col("v") == nodes["node"], "left_anti")
    return marked.where("_chosen").withColumn("assembled", F.lit(True)).drop("_chosen").unionByName(free.drop("_chosen"), allowMissingColumns=True)


def on_reference(edges: DataFrame, chroms: DataFrame) -> DataFrame:
    """``edges`` (chromx, chromy, ...) whose both sides lie on chromosomes of ``chroms``."""
    known = lambda s: chroms.select(F.col("chrom").alias(f"chrom{s}")).distinct()
    return edges.join(known("x"), "chromx", "left_semi").join(known("y"), "chromy", "left_semi").select(*edges.columns)


def is_assembled(events: DataFrame, assemblies: DataFrame, key: str = "event_id") -> DataFrame:
    """(key): events that equal an assembly (chromx, x, orientationx, chromy, y, orientationy) as it is or with its sides swapped."""
    other = {"chromx": "chromy", "x": "y", "orientationx": "orientationy"}
    names = [*other, *other.values()]
    turn = other | {b: a for a, b in other.items()}
    both = assemblies.select(*names).unionByName(assemblies.select(*[F.col(turn[n]).alias(n) for n in names])).distinct()
    sided = events.withColumns({"orientationx": F.substring("orientation", 1, 1), "orientationy": F.substring("orientation", 2, 1)})
    return sided.join(both, names, "left_semi").select(key)


def best_at_both_ends(edges: DataFrame) -> DataFrame:
    """Edges that have the greatest ratio at each of their nodes, all compared at once."""
    rank = F.struct("ratio", "u", "v")
    best = edges.select(F.explode(F.array("u", "v")).alias("node"), rank.alias("r")).groupBy("node").agg(F.max("r").alias("r"))
    winners = best.groupBy("r").agg(F.count(F.lit(1)).alias("ends")).where("ends = 2").select(F.col("r.u").alias("u"), F.col("r.v").alias("v"))
    return edges.join(winners, ["u", "v"], "left_semi")


def facing_pairs(nodes: DataFrame, near: int = 100_000, least: int = 5_000) -> DataFrame:
    """(left_pos, right_pos, chrom): nodes (chrom, pos, orientation) that open to each other, ``least`` to below ``near`` apart."""
    left = nodes.where("orientation = '-'").select("chrom", F.col("pos").alias("left_pos"), (F.col("pos") + least).alias("_a"), (F.col("pos") + near - 1).alias("_b")).distinct()
    right = nodes.where("orientation = '+'").select("chrom", F.col("pos").alias("right_pos"), F.col("pos").alias("_c"), F.col("pos").alias("_d")).distinct()
    return overlap_join(left, right, ["chrom"], ("_a", "_b"), ("_c", "_d"), near).select("chrom", "left_pos", "right_pos")


def compare_breakpoints(pairs: DataFrame, events: DataFrame, fragments: DataFrame | Tips, near: int = -500, far: int = 5_000) -> DataFrame:
    """(event_a, event_b, dataset, shared, total, p): common barcodes of two events' crossing barcodes, in the dataset with the least p.

    ``pairs`` has (event_a, event_b). Pairs without a common barcode have no row. Only the surroundings of events in pairs are looked at.
    """
    scratch = Scratch(events.sparkSession, "compared")
    pairs = scratch.table(pairs)
    own = events.join(pairs.select(F.explode(F.array("event_a", "event_b")).alias("event_id")).distinct(), "event_id", "left_semi")
    tips = fragments if isinstance(fragments, Tips) else Tips(fragments)
    crossing = scratch.table(tips.crossing(own, breakends(own), near, far))
    tips.forget()
    sizes = crossing.groupBy("event_id", "dataset").agg(F.count(F.lit(1)).alias("n"))
    a = pairs.join(crossing.withColumnRenamed("event_id", "event_a"), "event_a")
    common = a.join(crossing.withColumnRenamed("event_id", "event_b"), ["event_b", "dataset", "bc"]).groupBy("event_a", "event_b", "dataset").agg(F.count(F.lit(1)).alias("shared"))
    na, nb = sizes.select(F.col("event_id").alias("event_a"), "dataset", F.col("n").alias("na")), sizes.select(F.col("event_id").alias("event_b"), "dataset", F.col("n").alias("nb"))
    good = events.sparkSession.createDataFrame(list(tips.good.items()), "dataset string, good bigint")
    both = common.join(na, ["event_a", "dataset"]).join(nb, ["event_b", "dataset"]).join(good, "dataset").withColumn("total", F.col("na") + F.col("nb") - F.col("shared"))
    tested = both.withColumn("p", fisher_greater("shared", F.col("na") - F.col("shared"), F.col("nb") - F.col("shared"), F.col("good") - F.col("total")))
    return tested.groupBy("event_a", "event_b").agg(F.min_by(F.struct("dataset", "shared", "total", "p"), F.struct("p", "dataset")).alias("_b")).select("event_a", "event_b", "_b.*")


def supported_facing_edges(best: DataFrame, events: DataFrame, fragments: DataFrame, min_ratio: float = 0.01, min_shared: int = 20, max_p: float = 1e-4) -> DataFrame:
    """(u, v, kind, p, shared, total): facing nodes of ``best``, in which a node has one edge, whose two breakpoints have enough barcodes in common.

    ``best`` has (u, v, event_id, chromx, x, chromy, y, orientation).
    """
    end = lambda s, i: F.struct(F.col(f"chrom{s}").alias("chrom"), F.col(s).alias("pos"), F.substring("orientation", i, 1).alias("orientation"), "event_id")
    nodes = best.select(F.inline(F.array(end("x", 1), end("y", 2))))
    side = lambda pos, event: nodes.select("chrom", F.col("pos").alias(pos), "orientation", F.col("event_id").alias(event))
    left = side("left_pos", "event_a").where("orientation = '-'").drop("orientation")
    right = side("right_pos", "event_b").where("orientation = '+'").drop("orientation")
    near = facing_pairs(nodes).join(left, ["chrom", "left_pos"]).join(right, ["chrom", "right_pos"])
    pairs = near.select("event_a", "event_b").distinct()
    own = events.join(pairs.select(F.explode(F.array("event_a", "event_b")).alias("event_id")).distinct(), "event_id", "left_semi")
    tested = compare_breakpoints(pairs, own, fragments)
    passing = tested.where((F.col("shared") >= min_shared) & (F.col("shared") >= F.col("total") * min_ratio) & (F.col("p") <= max_p))
    u, v = node_key("chrom", "left_pos", F.lit("-")), node_key("chrom", "right_pos", F.lit("+"))
    return near.join(passing, ["event_a", "event_b"]).select(u.alias("u"), v.alias("v"), F.lit("facing").alias("kind"), "p", F.col("shared").cast("bigint").alias("shared"), F.col("total").cast("bigint").alias("total"))


def edge_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (u, v, ...) with ``cluster``, the least node of their component."""
    of = components(edges.select("u", "v"), scratch)
    return edges.join(of.select(F.col("node").alias("u"), F.col("component").alias("cluster")), "u")


def _cycle_ranks(edges: list[tuple[str, str]]) -> list[bool]:
    """Which of ``edges``, by rank, go when the first edge at any node of a cycle is removed until there is no cycle.

    A kept edge was at no cycle when its turn came, and removals make no cycles; so an edge goes if one of its nodes is on a cycle
    of the edges from its own rank on. Edges are added from the last; one that closes a cycle marks the nodes of its tree path,
    which are then contracted, so that each node is passed once.
    """
    number: dict[str, int] = {}
    ends = [(number.setdefault(a, len(number)), number.setdefault(b, len(number))) for a, b in edges]
    n = len(number)

    def find(of: list[int], x: int) -> int:
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    tree, joined = [False] * len(ends), list(range(n))
    around: list[list[int]] = [[] for _ in range(n)]
    for i in reversed(range(len(ends))):
        a, b = ends[i]
        x, y = find(joined, a), find(joined, b)
        if x != y:
            joined[x] = y
            tree[i] = True
            around[a].append(b)
            around[b].append(a)
    up, depth = [-1] * n, [-1] * n
    for root in range(n):
        if depth[root] < 0:
            depth[root], todo = 0, [root]
            for node in todo:
                for other in around[node]:
                    if depth[other] < 0:
                        up[other], depth[other] = node, depth[node] + 1
                        todo.append(other)
    top, since = list(range(n)), [-1] * n  # the highest node contracted with each; the last rank from which it is on a cycle
    for i in reversed(range(len(ends))):
        if not tree[i]:
            for x in ends[i]:
                since[x] = max(since[x], i)
            a, b = (find(top, x) for x in ends[i])
            while a != b:
                if depth[a] < depth[b]:
                    a, b = b, a
                since[a], since[up[a]] = max(since[a], i), max(since[up[a]], i)
                top[a] = up[a]
                a = find(top, a)
    return [max(since[a], since[b]) >= i for i, (a, b) in enumerate(ends)]


def clean_components(edges: DataFrame) -> DataFrame:
    """(cluster, u, v, kind, p, and shared and total if there) of ``edges`` after cleaning every cluster by itself.

    A cluster is held by one task, which takes time in proportion to its edges, but for sorting them. It can't grow with the
    data: nodes are preclustered breakends, at least ``precluster``'s gap apart on the reference, each has one breakpoint edge
    and facing edges to what lies within ``facing_pairs``' reach, so the reference alone bounds the edges.

    While there is a cycle, the edge with the least p at any of its nodes goes; then, once, nodes with a single edge that is a
    facing one. Equal p is decided by the nodes' keys.
    """

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["p", "u", "v"])
        left = left[~np.array(_cycle_ranks(list(zip(left["u"], left["v"]))), dtype=bool)]
        ends = pd.concat([left["u"], left["v"]])
        degree = ends.value_counts()
        loose = left["u"].map(degree).eq(1) | left["v"].map(degree).eq(1)
        return plain(left[~(loose & (left["kind"] == "facing"))])

    rest = [c for c in ("shared", "total") if c in edges.columns]
    rows = edges.select("cluster", "u", "v", "kind", "p", *rest).dropDuplicates(["u", "v"]).where("u <> v")
    return rows.groupBy("cluster").applyInPandas(clean, rows.schema)


def event_paths(edges: DataFrame) -> DataFrame:
    """(cluster, step, u, v, kind): the edges of the shortest path between the first and the last end of each cluster, in order; none where it has no two ends."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        around: dict[str, list[str]] = {}
        for a, b in zip(pdf["u"], pdf["v"]):
            around.setdefault(a, []).append(b)
            around.setdefault(b, []).append(a)
        ends = sorted(n for n, o in around.items() if len(o) == 1)
        if len(ends) < 2:
            return pd.DataFrame(columns=["cluster", "step", "u", "v", "kind"])
        back, todo = {ends[0]: None}, [ends[0]]
        for node in todo:
            for other in sorted(around[node]):
                if other not in back:
                    back[other] = node
                    todo.append(other)
        path = [next((e for e in reversed(ends) if e in back), ends[0])]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        kinds = {frozenset(k): v for k, v in zip(zip(pdf["u"], pdf["v"]), pdf["kind"])}
        return pd.DataFrame([(pdf["cluster"].iloc[0], i, a, b, kinds[frozenset((a, b))]) for i, (a, b) in enumerate(zip(path, path[1:]))], columns=["cluster", "step", "u", "v", "kind"])

    return edges.select("cluster", "u", "v", "kind").groupBy("cluster").applyInPandas(walk, "cluster string, step bigint, u string, v string, kind string")
