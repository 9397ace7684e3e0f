"""Fragments around breakends, counted in tasks from files of fragment tips, so that no pair of breakend and fragment is ever shuffled."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.functions.stats import fisher_tails
from fragloom.session import Scratch

#: Positions of one file, elements counted at once, events counted at once; what an element's place takes in its sort key.
TILE, MOST, EVENTS, PLACE = 1 << 22, 1 << 20, 1 << 12, 21
SIDES = {"x": 0, "y": 1}


def _open(path: str) -> tuple[pf.FileSystem, str]:
    if path.startswith("/"):
        return pf.LocalFileSystem(), path
    if path.startswith("file:"):
        return pf.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pf.FileSystem.from_uri(path)


def _name(root: str, chrom: str, tip: str, tile: int) -> str:
    return f"{root}/{quote(chrom, safe='')}.{'end' if tip == '+' else 'start'}.{tile}"


def _save(root: str, chrom: str, tip: str, tile: int, parts: dict[str, np.ndarray], names: list[str]) -> None:
    fs, base = _open(root)
    fs.create_dir(base, recursive=True)
    head = json.dumps({"names": names, "n": len(parts["at"]), "types": {k: v.dtype.str for k, v in parts.items()}}).encode()
    head += b" " * (-len(head) % 8)
    path = _name(base, chrom, tip, tile)
    own = f"{path}.{uuid.uuid4().hex}"  # a task that runs twice writes the same file twice
    with fs.open_output_stream(own) as out:
        out.write(len(head).to_bytes(8, "little"))
        out.write(head)
        for v in parts.values():
            out.write(np.ascontiguousarray(v).tobytes())
    fs.move(own, path)


def _load(fs: pf.FileSystem, path: str) -> tuple[list[str], dict[str, np.ndarray]] | None:
    """The names of a file's groups and its columns, the widest first so that all are aligned; mapped into memory where it is a local file."""
    if fs.get_file_info(path).type == pf.FileType.NotFound:
        return None
    if isinstance(fs, pf.LocalFileSystem):
        whole = np.asarray(np.memmap(path, dtype=np.uint8, mode="r"))
    else:
        with fs.open_input_file(path) as f:
            whole = np.frombuffer(f.read(), dtype=np.uint8)
    at = 8 + int.from_bytes(whole[:8].tobytes(), "little")
    head = json.loads(whole[8:at].tobytes())
    parts = {}
    for k, kind in head["types"].items():
        size = np.dtype(kind).itemsize * head["n"]
        parts[k] = whole[at : at + size].view(kind)
        at += size
    return head["names"], parts


def _small(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int32) if len(v) and abs(v).max() < 1 << 31 else v


class Tips:
    """The ends of usable fragments with a barcode, in files by chromosome, end and ``TILE`` positions, in order of position.

    They lie in the shared folder and are written once; tasks on events map the files and look up what lies around each
    breakend. A barcode goes by a 64-bit hash of itself and its group. Rows that are given twice count once. ``good`` has the
    distinct barcodes of each group.
    """

    def __init__(self, fragments: DataFrame, group: str = "dataset"):
        spark = fragments.sparkSession
        self.scratch, self.group, self.spark = Scratch(spark, "tips"), group, spark
        root = self.root = f"{self.scratch.root}/files"
        first, last = (F.shiftright(F.col(c).cast("bigint"), TILE.bit_length() - 1) for c in ("start_pos", "end_pos"))
        hap = F.when(F.col("hap").isin(0, 2), 1).when(F.col("hap") == 1, 2).otherwise(0).cast("tinyint") if "hap" in fragments.columns else F.lit(0).cast("tinyint")
        frag = F.coalesce(F.col("frag_id").cast("bigint"), F.lit(-(1 << 63))) if fragments.schema["frag_id"].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("frag_id")
        good = F.coalesce((F.col("end_pos") > F.col("start_pos")) & (F.col("end_pos") >= 0) & F.col("chrom").isNotNull(), F.lit(False))
        tiles = F.when(~good, F.array(-1 - F.pmod(frag, F.lit(64)))).when((first < 0) | (first == last), F.array(last)).otherwise(F.array(first, last))
        # a filter on the barcode would have its text made out once more for every row, so rows without one are dropped in the tasks
        hap = F.when(F.col("bc").isNull(), -1).otherwise(hap).cast("tinyint")
        rows = fragments.where(F.col(group).isNotNull())
        rows = rows.select(F.when(good, F.col("chrom")).otherwise("").alias("chrom"), F.explode(tiles).alias("tile"), F.col(group).alias("g"), F.xxhash64(group, "bc").alias("bc"), frag.alias("frag"), F.when(good, F.col("start_pos").cast("bigint")).alias("start_pos"), F.when(good, F.col("end_pos").cast("bigint")).alias("end_pos"), hap.alias("hap"))

        def write(key: tuple, table: pa.Table) -> pa.Table:
            chrom, t = key[0].as_py(), key[1].as_py()
            table = table.filter(pc.greater_equal(table["hap"], 0))
            if not len(table):
                return pa.table({"g": pa.array([], pa.string()), "bc": pa.array([], pa.int64())})
            g = table["g"].combine_chunks().dictionary_encode()
            g = g.combine_chunks() if isinstance(g, pa.ChunkedArray) else g
            names, code = g.dictionary.to_pylist(), g.indices.to_numpy(zero_copy_only=False)
            code = code.astype(np.int16 if len(names) < 1 << 15 else np.int32)
            bc, frag = table["bc"].to_numpy(), table["frag"].to_numpy()
            first = np.unique(bc, return_index=True)[1]
            seen = pa.table({"g": pa.array(np.array(names, dtype=object)[code[first]], pa.string()), "bc": bc[first]})
            if t >= 0:
                start, end, hap = table["start_pos"].to_numpy(), table["end_pos"].to_numpy(), table["hap"].to_numpy()
                order = np.lexsort((hap, bc, end, start, frag))
                cols = [v[order] for v in (frag, start, end, bc, hap)]
                order = order[np.append(True, np.logical_or.reduce([v[1:] != v[:-1] for v in cols]))]
                start, end, hap, bc, frag, code = (v[order] for v in (start, end, hap, bc, frag, code))
                for tip, at in (("+", end), ("-", start)):
                    own = np.flatnonzero(at // TILE == t)
                    own = own[np.argsort(at[own], kind="stable")]
                    if len(own):
                        parts = {"bc": bc[own], "frag": frag[own], "len": _small((end - start)[own]), "at": (at[own] - t * TILE).astype(np.int32), "g": code[own], "hap": hap[own]}
                        _save(root, chrom, tip, t, parts, names)
            return seen

        seen = self.scratch.table(rows.groupBy("chrom", "tile").applyInArrow(write, "g string, bc bigint"))
        self.good = {r.g: r.good for r in seen.groupBy("g").agg(F.count_distinct("bc").alias("good")).collect()}
        self.scratch.drop(seen)

    def forget(self) -> None:
        """Deletes the files; what was made of them has to be written before."""
        self.scratch.forget()

    def around(self, ends: DataFrame, near: int, far: int, use: Callable[[pa.Table, dict], pa.Table], schema: str, key: str = "event_id") -> DataFrame:
        """Calls ``use`` with breakends (key, side, chrom, pos, orientation) of whole events, at most ``EVENTS``, and the fragments around them.

        Those come as columns: end (the row of the breakend, in order), bc, frag, len, at, g (a number in ``good``'s order), hap.
        """
        root, number = self.root, {g: i for i, g in enumerate(self.good)}
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ends = ends.where(F.col("orientation").isin("+", "-")).select(key, "side", "chrom", F.col("pos").cast("bigint").alias("pos"), "orientation").where("chrom IS NOT NULL AND pos IS NOT NULL")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = list(batches)
            if not batches or not sum(len(b) for b in batches):
                return
            table = pa.Table.from_batches(batches).combine_chunks()
            code = table[key].combine_chunks().dictionary_encode()
            code = code.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            table, code = table.take(pa.array(order)), code[order]
            pos, plus = table["pos"].to_numpy(), pc.equal(table["orientation"], "+").to_numpy(zero_copy_only=False)
            low = np.where(plus, np.maximum(pos - far + 1, 0), np.maximum(pos + near, 0))
            high = np.where(plus, pos - near, pos + far)
            names = table["chrom"].combine_chunks().dictionary_encode()
            chroms, chrom = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            fs, base = _open(root)
            first, last = low // TILE, high // TILE
            pieces = np.where(high >= low, last - first + 1, 0)
            end = np.repeat(np.arange(len(pos)), pieces)
            tile = first[end] + np.arange(len(end)) - (np.cumsum(pieces) - pieces)[end]
            at = np.lexsort((tile, plus[end], chrom[end]))
            same = np.zeros(len(at), dtype=bool)
            same[1:] = (chrom[end[at]][1:] == chrom[end[at]][:-1]) & (plus[end[at]][1:] == plus[end[at]][:-1]) & (tile[at][1:] == tile[at][:-1])
            cuts = np.append(np.flatnonzero(~same), len(at))
            a, b, file = (np.zeros(len(end), dtype=np.int64) for _ in range(3))
            where: list[str] = []
            for c0, c1 in zip(cuts[:-1], cuts[1:]):
                own = at[c0:c1]
                e = end[own[0]]
                path = _name(base, chroms[chrom[e]], "+" if plus[e] else "-", int(tile[own[0]]))
                got = _load(fs, path)
                if got:
                    x = got[1]["at"]
                    off = tile[own[0]] * TILE
                    a[own] = np.searchsorted(x, np.clip(low[end[own]] - off, -1, TILE).astype(np.int32), "left")
                    b[own] = np.searchsorted(x, np.clip(high[end[own]] - off, -1, TILE).astype(np.int32), "right")
                file[own] = len(where)
                where.append(path)
            size = b - a
            per = np.bincount(code, weights=np.bincount(end, weights=size, minlength=len(pos)), minlength=code[-1] + 1).astype(np.int64)
            starts = np.searchsorted(code, np.arange(code[-1] + 2))
            done, events = 0, len(per)
            total = np.concatenate(([0], np.cumsum(per)))
            while done < events:
                upto = int(np.searchsorted(total, total[done] + MOST, "right")) - 1
                upto = min(max(upto, done + 1), done + EVENTS, events)
                r0, r1 = starts[done], starts[upto]
                p0, p1 = np.searchsorted(end, [r0, r1])
                done = upto
                own = np.arange(p0, p1)[size[p0:p1] > 0]
                n_all = int(size[own].sum())
                if not n_all:
                    continue
                begin = np.cumsum(size[own]) - size[own]  # pieces are in order of their breakends
                cols: dict[str, np.ndarray] = {"end": np.repeat(end[own] - r0, size[own])}
                for k, kind in (("bc", np.int64), ("frag", np.int64), ("len", np.int64), ("at", np.int64), ("g", np.int32), ("hap", np.int8)):
                    cols[k] = np.empty(n_all, dtype=kind)
                by = np.argsort(file[own], kind="stable")
                edges = np.append(np.flatnonzero(np.diff(file[own][by], prepend=-1)), len(by))
                for c0, c1 in zip(edges[:-1], edges[1:]):
                    p = by[c0:c1]
                    q = own[p]
                    lens = size[q]
                    step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
                    src, dst = step + np.repeat(a[q], lens), step + np.repeat(begin[p], lens)
                    its, parts = _load(fs, where[file[q[0]]])
                    for k in ("bc", "frag", "len", "hap"):
                        cols[k][dst] = parts[k][src]
                    cols["at"][dst] = parts["at"][src] + tile[q[0]] * TILE
                    cols["g"][dst] = np.array([number[g] for g in its], dtype=np.int32)[parts["g"][src]]
                out = use(table.slice(r0, r1 - r0), cols)
                if len(out):
                    yield from out.combine_chunks().to_batches(max_chunksize=100_000)

        return ends.repartition(n, key).mapInArrow(count, schema)

    def _counted(self, events: DataFrame, ends: DataFrame, near: int, far: int, emit: Callable, columns: str, key: str) -> DataFrame:
        kind = events.schema[key].dataType.simpleString()

        def use(table: pa.Table, cols: dict) -> pa.Table:
            codes = table[key].combine_chunks().dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            side = pc.equal(table["side"], "y").to_numpy(zero_copy_only=False).astype(np.int8)
            return emit(table, codes.dictionary, code[cols["end"]], side[cols["end"]], cols)

        return self.around(ends, near, far, use, f"`{key}` {kind}, {columns}", key)

    def quantify(self, events: DataFrame, ends: DataFrame, near: int, far: int, key: str = "event_id", quantiles: Sequence[float] = ()) -> DataFrame:
        """``support.quantify`` of events by their breakends, with these ``quantiles`` of ``genotype.joined_lengths`` as lengths_50 and so on, null without a pair."""
        names, goods = list(self.good), np.array(list(self.good.values()), dtype=np.int64)
        hap_names = [f"{s}_hap{h}" for s in "xy" for h in "01"]

        def emit(table: pa.Table, keys: pa.Array, event: np.ndarray, side: np.ndarray, cols: dict) -> pa.Table:
            per = by_barcode(event, side, cols)
            cell, place = np.unique(per["event"] * len(names) + per["g"], return_inverse=True)
            crossed = (per["nx"] > 0) & (per["ny"] > 0)
            add = lambda w: np.bincount(place, weights=w, minlength=len(cell)).astype(np.int64)
            shared, total = add(crossed), add(None)
            only_x, only_y = add(per["ny"] == 0), add(per["nx"] == 0)
            c = np.flatnonzero(crossed)
            haps = []
            for s in "xy":
                for h in "01":
                    w = per[f"h{s}{h}"][c] * per["ny" if s == "x" else "nx"][c] - per[f"h{s}{h}_same"][c]
                    haps.append(np.bincount(place[c], weights=w, minlength=len(cell)).astype(np.int64))
            g = cell % len(names)
            p = fisher_tails(shared, only_x, only_y, goods[g] - total)
            out = pa.table({key: keys.take(pa.array(cell // len(names))), "g": pa.array(names, pa.string()).take(pa.array(g)), "shared": shared, "total": total, "only_x": only_x, "only_y": only_y, **dict(zip(hap_names, haps)), "p_fisher": pa.array(p, mask=np.isnan(p))})
            if quantiles:
                left, right, length = pairs(table, event, side, cols)
                found, q = percentiles(event[left] * len(names) + cols["g"][left], length, quantiles)
                for x, v in zip(quantiles, q):
                    whole, known = np.zeros(len(cell)), np.zeros(len(cell), dtype=bool)
                    at = np.searchsorted(cell, found)
                    whole[at], known[at] = v, True
                    out = out.append_column(f"lengths_{round(x * 100)}", pa.array(whole, mask=~known))
            return out

        doubles = ["p_fisher", *[f"lengths_{round(x * 100)}" for x in quantiles]]
        longs = ", ".join(f"{n} bigint" for n in ("shared", "total", "only_x", "only_y", *hap_names))
        out = self._counted(events, ends, near, far, emit, f"g string, {longs}, {', '.join(f'{d} double' for d in doubles)}", key)
        return out.select(F.col("g").alias(self.group), key, "shared", "total", "only_x", "only_y", *hap_names, *doubles)

    def confirmed(self, events: DataFrame, ends: DataFrame, near: int, far: int, wide: int, key: str = "event_id") -> DataFrame:
        """(key, group, shared, total, confirming) of ``quantify``, where confirming is what ``shared`` is with ``wide``, which is ``far`` or more, in its place.

        Rows in which neither shares a barcode are left out.
        """
        names = list(self.good)

        def emit(table: pa.Table, keys: pa.Array, event: np.ndarray, side: np.ndarray, cols: dict) -> pa.Table:
            plus, pos = pc.equal(table["orientation"], "+").to_numpy(zero_copy_only=False), table["pos"].to_numpy()
            inside = np.where(plus[cols["end"]], cols["at"] > pos[cols["end"]] - far, cols["at"] <= pos[cols["end"]] + far)
            few, many = by_barcode(event[inside], side[inside], {k: v[inside] for k, v in cols.items()}), by_barcode(event, side, cols)
            cell, place = np.unique(few["event"] * len(names) + few["g"], return_inverse=True)
            shared = np.bincount(place, weights=(few["nx"] > 0) & (few["ny"] > 0), minlength=len(cell)).astype(np.int64)
            total = np.bincount(place, minlength=len(cell))
            crossed = (many["nx"] > 0) & (many["ny"] > 0)
            there, n = np.unique((many["event"] * len(names) + many["g"])[crossed], return_counts=True)
            confirming = np.zeros(len(cell), dtype=np.int64)
            known = np.isin(there, cell)
            confirming[np.searchsorted(cell, there[known])] = n[known]
            at = np.flatnonzero((shared > 0) | (confirming > 0))
            return pa.table({key: keys.take(pa.array(cell[at] // len(names))), "g": pa.array(names, pa.string()).take(pa.array(cell[at] % len(names))), "shared": shared[at], "total": total[at], "confirming": confirming[at]})

        out = self._counted(events, ends, near, wide, emit, "g string, shared bigint, total bigint, confirming bigint", key)
        return out.withColumnRenamed("g", self.group)

    def crossing(self, events: DataFrame, ends: DataFrame, near: int, far: int, key: str = "event_id") -> DataFrame:
        """(key, group, bc): barcodes, by their hashes, with fragments on both sides that are not one and the same."""
        names = list(self.good)

        def emit(table: pa.Table, keys: pa.Array, event: np.ndarray, side: np.ndarray, cols: dict) -> pa.Table:
            per = by_barcode(event, side, cols)
            at = np.flatnonzero((per["nx"] > 0) & (per["ny"] > 0))
            return pa.table({key: keys.take(pa.array(per["event"][at])), "g": pa.array(names, pa.string()).take(pa.array(per["g"][at])), "bc": per["bc"][at]})

        out = self._counted(events, ends, near, far, emit, "g string, bc bigint", key)
        return out.withColumnRenamed("g", self.group)

    def refined(self, ends: DataFrame, extend: int = 20_000, key: str = "event_id") -> DataFrame:
        """(key, side, pos, new_pos, n): ``candidates.refine_breakends`` of breakends and the fragments within ``extend``."""
        kind = ends.schema[key].dataType.simpleString()

        def use(table: pa.Table, cols: dict) -> pa.Table:
            plus, pos = pc.equal(table["orientation"], "+").to_numpy(zero_copy_only=False), table["pos"].to_numpy()
            end, at = cols["end"], cols["at"] - pos[cols["end"]] + extend
            low = np.maximum(np.where(plus[end], at - cols["len"], at), 0)
            high = np.minimum(np.where(plus[end], at, at + cols["len"]), 2 * extend + 1)
            own, to, n = steepest_drops(end, low, high, plus, 2 * extend + 1)
            return pa.table({key: table[key].take(pa.array(own)), "side": table["side"].take(pa.array(own)), "pos": pos[own], "new_pos": pos[own] - extend + to, "n": n})

        return self.around(ends, -extend, extend, use, f"`{key}` {kind}, side string, pos bigint, new_pos bigint, n bigint", key)


def _ordered(event: np.ndarray, bc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by event and barcode, and where in it another of them begins: one sort of whole numbers, then exact order where parts of hashes are equal."""
    n = len(event)
    if n >= 1 << PLACE:
        order = np.lexsort((bc, event))
        top = event[order].astype(np.uint64)
    else:
        some = bc.view(np.uint64) >> np.uint64(64 - (64 - PLACE - 12))
        key = (event.astype(np.uint64) << np.uint64(52)) | (some << np.uint64(PLACE)) | np.arange(n, dtype=np.uint64)
        key.sort()
        order, top = (key & np.uint64((1 << PLACE) - 1)).astype(np.int64), key >> np.uint64(PLACE)
    b = bc[order]
    same = top[1:] == top[:-1]
    if n < 1 << PLACE and (mixed := same & (b[1:] != b[:-1])).any():
        run = np.concatenate(([0], np.cumsum(~same)))
        bad = np.zeros(run[-1] + 1, dtype=bool)
        bad[run[1:][mixed]] = True
        at = np.flatnonzero(bad[run])
        order[at] = order[at][np.lexsort((b[at], run[at]))]
        b = bc[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ~same | (b[1:] != b[:-1])
    return order, new


def by_barcode(event: np.ndarray, side: np.ndarray, cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``support.support_by_barcode`` of the fragments around breakends: one element for each event and barcode."""
    order, new = _ordered(event, cols["bc"])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    one = size == 1
    single = order[start[one]]
    hx, h = side[single] == 0, cols["hap"][single]
    zero = np.zeros(len(single), dtype=np.int64)
    out = {"event": [event[single]], "g": [cols["g"][single]], "bc": [cols["bc"][single]], "nx": [hx.astype(np.int64)], "ny": [(~hx).astype(np.int64)], "same": [zero]}
    for s in "xy":
        for k in "01":
            out[f"h{s}{k}"] = [((hx if s == "x" else ~hx) & (h == int(k) + 1)).astype(np.int64)]
            out[f"h{s}{k}_same"] = [zero]
    many = order[np.repeat(~one, size)]
    if len(many):
        group = np.repeat(np.arange(int((~one).sum())), size[~one])
        frag = cols["frag"][many]
        by = np.lexsort((frag, group))
        many, group, frag = many[by], group[by], frag[by]
        fresh = np.ones(len(many), dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (frag[1:] != frag[:-1])
        at = np.flatnonzero(fresh)
        flags = np.bitwise_or.reduceat((1 << side[many].astype(np.int64)) | (cols["hap"][many].astype(np.int64) << 2), at)
        group = group[at]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        lead = many[at][head]
        add = lambda v: np.add.reduceat(v, head)
        ix, iy = flags & 1, flags >> 1 & 1
        for k, v in (("event", event[lead]), ("g", cols["g"][lead]), ("bc", cols["bc"][lead]), ("nx", add(ix)), ("ny", add(iy)), ("same", add(ix & iy))):
            out[k].append(v)
        for s, i in (("x", ix), ("y", iy)):
            for k in "01":
                hap = flags >> (2 + int(k)) & 1
                out[f"h{s}{k}"].append(add(i & hap))
                out[f"h{s}{k}_same"].append(add(ix & iy & hap))
    whole = {k: np.concatenate(v) for k, v in out.items()}
    kept = ~((whole["nx"] == 1) & (whole["ny"] == 1) & (whole["same"] == 1))
    return whole if kept.all() else {k: v[kept] for k, v in whole.items()}


def pairs(table: pa.Table, event: np.ndarray, side: np.ndarray, cols: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``genotype.joined_lengths``: the elements of each pair, its x before its y, and the length of its molecule."""
    plus = pc.equal(table["orientation"], "+").to_numpy(zero_copy_only=False)[cols["end"]]
    pos = table["pos"].to_numpy()[cols["end"]]
    part = np.where(plus, pos - cols["at"], cols["at"] - pos) + cols["len"]
    order, new = _ordered(event, cols["bc"])
    group = np.cumsum(new) - 1
    has = [np.bincount(group[side[order] == s], minlength=len(order)) for s in (0, 1)]
    both = ((has[0] > 0) & (has[1] > 0))[group]
    order, group = order[both], group[both]
    by = np.lexsort((part[order], cols["frag"][order], side[order], group))
    order, group = order[by], group[by]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in (group, side[order], cols["frag"][order], part[order])])
    order, group = order[fresh], group[fresh]
    x, y = (np.flatnonzero(side[order] == s) for s in (0, 1))
    low, high = np.searchsorted(group[y], group[x], "left"), np.searchsorted(group[y], group[x], "right")
    n = high - low
    left = order[np.repeat(x, n)]
    right = order[y[np.arange(int(n.sum())) + np.repeat(low - np.cumsum(n) + n, n)]]
    two = cols["frag"][left] != cols["frag"][right]
    left, right = left[two], right[two]
    return left, right, part[left] + part[right]


def percentiles(cell: np.ndarray, value: np.ndarray, quantiles: Sequence[float]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different cells, in order, and the quantiles of their values, between two of them in proportion as Spark's percentile has it."""
    by = np.lexsort((value, cell))
    cell, value = cell[by], value[by]
    head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, dtype=np.int64)
    most = np.diff(np.append(head, len(cell))) - 1
    out = []
    for q in quantiles:
        at = most * q
        low, high = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
        a, b = value[head + low].astype(np.float64), value[head + high].astype(np.float64)
        out.append(np.where(a == b, a, (high - at) * a + (at - low) * b))
    return cell[head], out


def steepest_drops(end: np.ndarray, low: np.ndarray, high: np.ndarray, plus: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``candidates.steepest_drop`` of the coverage of [low, high) within ``width`` positions, for each number in ``end``: (numbers, places, fragments).

    Between two changes of the coverage only the first and the last position can be the steepest drop, so no others are looked at.
    """
    some = low < high
    end, low, high = end[some], low[some], high[some]
    if not len(end):
        return end, end, end
    n_of = np.bincount(end, minlength=len(plus))
    own = np.flatnonzero(n_of)
    wide = width + 1
    key = np.concatenate((own * wide * 4, (end * wide + low) * 4 + 1, (end * wide + high) * 4 + 2))
    key.sort()
    step = np.array([0, 1, -1])[key & 3]
    key >>= 2
    last = np.append(key[1:] != key[:-1], True)
    cover, key = np.cumsum(step)[last], key[last]
    e, start = key // wide, key % wide
    inside = start < width
    cover, e, start = cover[inside], e[inside], start[inside]
    head = np.flatnonzero(np.diff(e, prepend=-1))
    stop = np.append(start[1:] - 1, width - 1)
    stop[np.append(head[1:], len(e)) - 1] = width - 1
    count = np.diff(np.append(head, len(e)))
    i = np.repeat(np.arange(len(own)), count)
    tall = cover > 0.9 * np.maximum.reduceat(cover, head)[i]
    up = plus[own]
    at = np.arange(len(e))
    seg = np.where(up, np.minimum.reduceat(np.where(tall, at, len(e)), head), np.maximum.reduceat(np.where(tall, at, -1), head))
    peak, height = np.where(up, start[seg], stop[seg]), cover[seg]
    c0, c1 = np.where(up, peak + 1, 0)[i], np.where(up, width - 1, peak - 1)[i]
    a, b = np.maximum(start, c0), np.minimum(stop, c1)
    some = np.flatnonzero(a <= b)
    i, place, cover = np.repeat(i[some], 2), np.stack((a[some], b[some]), axis=1).ravel(), np.repeat(cover[some], 2)
    score = (height[i] - cover) / np.sqrt(np.abs(place - peak[i]))
    to = peak.copy()
    if len(i):
        head = np.flatnonzero(np.diff(i, prepend=-1))
        top = np.maximum.reduceat(score, head)
        best = score == np.repeat(top, np.diff(np.append(head, len(i))))
        to[i[head]] = np.minimum.reduceat(np.where(best, place, width), head)
    return own, to, n_of[own]
