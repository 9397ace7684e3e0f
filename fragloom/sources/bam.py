"""Binary alignments as a Spark source, with the columns of ``files.read_sam``.

A BAM file is a row of small compressed blocks; a record is found by its block's place in the file and its own place in that
block. The index beside the file (``.bai``) names places where records start, at most one for 16 kb of the reference, so an
indexed file is cut there into tasks of about ``split_bytes`` each and read in parallel, whatever its size. A file without an
index is one task. Records are decoded in Arrow batches. Paths must be on a file system that all executors have mounted.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
BATCH = 8_192
END = 1 << 63
# fixed values of the format
OPS = "MIDNSHP=X"
BASES = str.maketrans("0123456789abcdef", "=ACMGRSVTWYHKDBN")
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}
METADATA_BIN = 37_450
SCHEMA = (
    "read_name string, flag int, chrom string, pos bigint, mapq int, cigar array<struct<len: bigint, op: string>>, next_chrom string, "
    "next_pos bigint, insert_size bigint, seq string, bx string, rx string, hp int, ps bigint"
)


class Span(NamedTuple):
    """What one task reads: records that start from ``start`` up to before ``stop``, and of these the ones over a region."""

    path: str
    start: int
    stop: int
    sorted: bool


def _blocks(f: BinaryIO, at: int) -> Iterator[tuple[int, int, bytes]]:
    """(place, place of the next, content) of the blocks from ``at`` on."""
    f.seek(at)
    while head := f.read(12):
        if len(head) < 12:
            raise ValueError(f"{f.name} is cut off in the block at {at}")
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no block at {at} of {f.name}")
        extra = f.read(struct.unpack_from("<H", head, 10)[0])
        size, i = None, 0
        while i + 4 <= len(extra):
            length = struct.unpack_from("<H", extra, i + 2)[0]
            if extra[i : i + 2] == b"BC":
                size = struct.unpack_from("<H", extra, i + 4)[0] + 1
            i += 4 + length
        if size is None:
            raise ValueError(f"no block size at {at} of {f.name}")
        body = f.read(size - 12 - len(extra))
        if len(body) < size - 12 - len(extra):
            raise ValueError(f"{f.name} is cut off in the block at {at}")
        yield at, at + size, zlib.decompress(body[:-8], -15)
        at += size


def _header(f: BinaryIO) -> tuple[list[str], int]:
    """Names of the reference and where the first record starts."""
    held, starts, need = b"", [], 12
    names: list[str] = []
    for at, following, data in _blocks(f, 0):
        starts.append((len(held), at))
        held += data
        if len(held) < 12 or len(held) < (need := 12 + struct.unpack_from("<i", held, 4)[0]):
            continue
        if held[:4] != b"BAM\1":
            break
        i, names = need, []
        for _ in range(struct.unpack_from("<i", held, need - 4)[0]):
            if len(held) < i + 4 or len(held) < i + 8 + (length := struct.unpack_from("<i", held, i)[0]):
                break
            names.append(held[i + 4 : i + 3 + length].decode())
            i += 8 + length
        else:
            if i == len(held):
                return names, following << 16
            before, block = max(s for s in starts if s[0] <= i)
            return names, block << 16 | (i - before)
    raise ValueError(f"{f.name} is no whole BAM file")


def _index(path: str) -> list[tuple[list[int], int, int]] | None:
    """Of each reference (its linear index, where its first record starts, where its last one ends); None without an index."""
    found = next((p for p in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai") if os.path.exists(p)), None)
    if found is None:
        return None
    with open(found, "rb") as f:
        data = f.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"{found} is no index")
    refs, i = [], 8
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        n_bins, i, first, last = struct.unpack_from("<i", data, i)[0], i + 4, END, 0
        for _ in range(n_bins):
            name, n = struct.unpack_from("<Ii", data, i)
            chunks = struct.unpack_from(f"<{2 * n}Q", data, i + 8)
            i += 8 + 16 * n
            if name != METADATA_BIN and n:
                first, last = min(first, *chunks[::2]), max(last, *chunks[1::2])
        n = struct.unpack_from("<i", data, i)[0]
        refs.append((list(struct.unpack_from(f"<{n}Q", data, i + 4)), first, last))
        i += 4 + 8 * n
    return refs


def _raw_records(f: BinaryIO, start: int, stop: int) -> Iterator[bytes]:
    """Records that start in [start, stop), both given as block << 16 | place in it."""
    rest, rest_at, skip = b"", start, start & 0xFFFF
    for at, _, data in _blocks(f, start >> 16):
        held = len(rest) - skip
        data, skip, i = rest + data[skip:], 0, 0
        carried = len(rest)
        while i < len(data):
            where = rest_at if i < carried else at << 16 | (i - held)
            if where >= stop:
                return
            if len(data) < i + 4 or len(data) < i + 4 + (size := struct.unpack_from("<i", data, i)[0]):
                rest_at = where
                break
            yield data[i + 4 : i + 4 + size]
            i += 4 + size
        rest = data[i:]
    if rest:
        raise ValueError(f"{f.name} ends within a record")


def _tags(raw: bytes, i: int) -> dict[str, object]:
    """The tags that the operators read, and CG, where a CIGAR too long for its own field is kept."""
    out: dict[str, object] = {}
    while i + 3 <= len(raw):
        tag, kind = raw[i : i + 2].decode("latin-1"), chr(raw[i + 2])
        i += 3
        if kind in "ZH":
            end = raw.index(0, i)
            value, size = (i, end), end - i + 1
        elif kind == "B":
            value, size = (i + 5, struct.unpack_from("<i", raw, i + 1)[0]), 0
            size = 5 + SIZES[chr(raw[i])] * value[1]
        else:
            value, size = None, SIZES[kind]
        if tag in ("BX", "RX") and kind == "Z":
            out[tag] = raw[value[0] : value[1]].decode("utf-8", "replace")
        elif tag in ("HP", "PS") and kind in CODES:
            out[tag] = struct.unpack_from("<" + CODES[kind], raw, i)[0]
        elif tag == "CG" and kind == "B" and raw[i : i + 1] == b"I":
            out[tag] = struct.unpack_from(f"<{value[1]}I", raw, value[0])
        i += size
    return out


def _row(raw: bytes, names: list[str]) -> tuple:
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, next_ref, next_pos, size = struct.unpack_from("<iiBBHHHiiii", raw)
    i = 32 + l_name
    ops = struct.unpack_from(f"<{n_ops}I", raw, i)
    i += 4 * n_ops
    seq = raw[i : i + (l_seq + 1) // 2].hex().translate(BASES)[:l_seq] or "*"
    tags = _tags(raw, i + (l_seq + 1) // 2 + l_seq)
    if n_ops == 2 and ops[0] == l_seq << 4 | 4 and "CG" in tags:
        ops = tags["CG"]
    cigar = [{"len": o >> 4, "op": OPS[o & 15]} for o in ops]
    name = lambda r: names[r] if r >= 0 else None
    return (
        raw[32 : 31 + l_name].decode("utf-8", "replace"), flag, name(ref), pos, mapq, cigar, name(next_ref), next_pos, size, seq,
        tags.get("BX"), tags.get("RX"), tags.get("HP"), tags.get("PS"),
    )


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for path in options["path"].split(",") for p in sorted(glob.glob(path))]
        self.chrom, self.low, self.high = options.get("chrom"), int(options.get("start", 0)), int(options.get("end", END))
        self.unmapped = options.get("unmapped", "false").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        if self.low < 0 or self.low >= self.high:
            raise ValueError("a region needs 0 <= start < end")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(span) for path in self.paths for span in self._spans(path)] or [InputPartition(None)]

    def _spans(self, path: str) -> list[Span]:
        with open(path, "rb") as f:
            names, first = _header(f)
        if self.chrom is not None and self.chrom not in names:
            return []
        refs = _index(path)
        if refs is None:
            return [Span(path, first, END, False)]
        if self.unmapped:
            # reads without a place come after all others; where they begin is where the last reference's reads end
            return [Span(path, max([first, *[last for _, begin, last in refs if begin < last]]), END, False)]
        low, high = first, END
        places = sorted({p for linear, begin, _ in refs for p in (*linear, begin) if first < p < END})
        if self.chrom is not None:
            linear, low, high = refs[names.index(self.chrom)]
            if low >= high:
                return []
            if self.low >> 14 < len(linear):
                low = max(low, linear[self.low >> 14])
            else:
                return []
        cuts = [low]
        for p in places:
            if cuts[-1] < p < high and (p >> 16) - (cuts[-1] >> 16) >= self.split_bytes:
                cuts.append(p)
        return [Span(path, a, b, True) for a, b in zip(cuts, [*cuts[1:], high])]

    def _rows(self, span: Span) -> Iterator[tuple]:
        with open(span.path, "rb") as f:
            names, _ = _header(f)
            want = names.index(self.chrom) if self.chrom is not None else None
            for raw in _raw_records(f, span.start, span.stop):
                ref, pos = struct.unpack_from("<ii", raw)
                if self.unmapped and ref >= 0:
                    continue
                if want is None:
                    yield _row(raw, names)
                    continue
                if span.sorted and ref == want and pos >= self.high:
                    return
                if ref != want or pos >= self.high:
                    continue
                row = _row(raw, names)
                # an unmapped read that is placed beside its mate counts as one base
                if pos + max(1, sum(o["len"] for o in row[5] if o["op"] in "MDN=X")) > self.low:
                    yield row

    def read(self, partition: InputPartition) -> Iterator:  # type: ignore[type-arg]
        import pyarrow as pa

        if partition.value is None:
            return
        text, whole, long = pa.string(), pa.int32(), pa.int64()
        types = [text, whole, text, long, whole, pa.list_(pa.struct([("len", long), ("op", text)])), text, long, long, text, text, text, whole, long]
        names = [c.split(" ")[0] for c in SCHEMA.replace("<len: bigint, op: string>", "").split(", ")]
        batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
        held: list[tuple] = []
        for row in self._rows(partition.value):
            held.append(row)
            if len(held) == BATCH:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


class BamSource(DataSource):
    """``spark.read.format("bam")``, with the options ``chrom``, ``start`` and ``end`` for the reads over a half-open region, ``unmapped`` for the reads without a place alone, and ``split_bytes``.

    A region, and the reads without a place, read only their part of an indexed file, the latter in one task a file. A chromosome that a file doesn't know has no reads in it. Unmapped reads
    have no chrom. Index files other than ``.bai`` are not read.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:  # type: ignore[no-untyped-def]
        return BamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
