"""Binary alignments against the same reads as SAM text."""

import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fragloom.sources import bam, files

REFS = [("c1", 100_000), ("c2", 50_000)]
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"


def sam_lines(n=400):
    out = []
    for c, length in REFS:
        for i in range(n):
            pos = 1 + i * (length - 200) // n
            tags = ["NM:i:3", f"BX:Z:AC{i % 7}-1,x"] + (["PS:i:70000", "HP:i:2"] if i % 3 else ["RX:Z:GG", "XB:B:s,1,-2", "XA:A:q"])
            cigar = ("50M", "10S20M5D20M", "30M2I18M")[i % 3]
            out.append([f"r{c}{i}", (0, 16, 1024)[i % 3], c, pos, i % 61, cigar, ("=", "c2", "*")[i % 3], 5, -7, "ACGTN" * 10, "I" * 50, *tags])
    out.append(["lost", 4, "*", 0, 0, "*", "*", 0, 0, "ACG", "III"])
    out.append(["bare", 4, "*", 0, 0, "*", "*", 0, 0, "*", "*"])
    return out


def record(f):
    names = [c for c, _ in REFS]
    ref = names.index(f[2]) if f[2] != "*" else -1
    mate = ref if f[6] == "=" else names.index(f[6]) if f[6] != "*" else -1
    ops = [(int(n), OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", f[5])]
    seq = "" if f[9] == "*" else f[9]
    nibbles = [BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2]))
    tags = b""
    for t in f[11:]:
        tag, kind, value = t.split(":", 2)
        tags += tag.encode() + kind.encode()
        if kind == "i":
            tags += struct.pack("<i", int(value))
        elif kind == "A":
            tags += value.encode()
        elif kind == "B":
            v = value.split(",")
            tags += v[0].encode() + struct.pack(f"<i{len(v) - 1}h", len(v) - 1, *map(int, v[1:]))
        else:
            tags += value.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, f[3] - 1, len(f[0]) + 1, f[4], 0, len(ops), f[1], len(seq), mate, f[7] - 1, f[8])
    body += f[0].encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + b"\x28" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def block(data):
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(path, lines, size, index):
    """Blocks of ``size`` bytes whatever the records are, so that records and header lie across them."""
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(REFS))
    head += b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in REFS)
    records = [record(f) for f in lines]
    data, places = head + b"".join(records), []
    with open(path, "wb") as out:
        for i in range(0, len(data), size):
            places.append(out.tell())
            out.write(block(data[i : i + size]))
        places.append(out.tell())
        out.write(block(b""))
    if not index:
        return
    voffset = lambda i: places[i // size] << 16 | i % size
    at, spans = len(head), {c: [] for c, _ in REFS}
    for f, r in zip(lines, records):
        if f[2] != "*":
            spans[f[2]].append((f[3] - 1, at, at + len(r)))
        at += len(r)
    with open(f"{path}.bai", "wb") as out:
        out.write(b"BAI\1" + struct.pack("<i", len(REFS)))
        for c, _ in REFS:
            s = spans[c]
            out.write(struct.pack("<i", 2) + struct.pack("<IiQQ", 4681, 1, voffset(s[0][1]), voffset(s[-1][2])))
            out.write(struct.pack("<IiQQQQ", 37450, 2, 0, 1 << 62, len(s), 0))
            linear = [voffset(min(a for p, a, _ in s if p + 60 > w << 14)) for w in range((s[-1][0] >> 14) + 1)]
            out.write(struct.pack(f"<i{len(linear)}Q", len(linear), *linear))


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    bam.register(spark)
    folder, lines = tmp_path_factory.mktemp("bam"), sam_lines()
    (folder / "a.sam").write_text("@HD\tVN:1.6\n" + "\n".join("\t".join(map(str, f)) for f in lines) + "\n")
    write_bam(folder / "a.bam", lines, 173, True)
    write_bam(folder / "b.bam", lines, 5_000, False)
    return folder, sorted(files.read_sam(spark, str(folder / "a.sam")).collect(), key=repr)


@pytest.mark.parametrize(("name", "split"), [("a.bam", 1 << 26), ("a.bam", 1), ("a.bam", 3_000), ("b.bam", 1)])
def test_all_records_once(spark, pair, name, split):
    folder, sam = pair
    df = spark.read.format("bam").option("split_bytes", split).load(str(folder / name))
    assert sorted(df.collect(), key=repr) == sam
    assert (df.rdd.getNumPartitions() > 1) == (name == "a.bam" and split < 1 << 26)


@pytest.mark.parametrize("name", ["a.bam", "b.bam"])
@pytest.mark.parametrize(("chrom", "start", "end"), [("c1", 0, 100_000), ("c1", 20_030, 40_000), ("c2", 49_000, 49_900), ("c2", 48_000, 48_001), ("c2", 49_990, 60_000), ("none", 0, 9)])
def test_regions(spark, pair, name, chrom, start, end):
    folder, _ = pair
    got = spark.read.format("bam").options(chrom=chrom, start=start, end=end, split_bytes=2_000).load(str(folder / name))
    sam = files.read_sam(spark, str(folder / "a.sam"))
    want = sam.where((F.col("chrom") == chrom) & (F.col("pos") < end) & (files.reference_end(F.col("pos"), F.col("cigar")) > start))
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    assert files.as_reads(got).count() == want.count()


@pytest.mark.parametrize("name", ["a.bam", "b.bam"])
def test_reads_without_a_place(spark, pair, name):
    folder, sam = pair
    got = spark.read.format("bam").option("unmapped", "true").load(str(folder / name)).collect()
    assert sorted(got, key=repr) == [r for r in sam if r.chrom is None] and got
    places = bam.BamReader({"path": str(folder / name), "unmapped": "true"})._spans(str(folder / name))
    whole = bam.BamReader({"path": str(folder / name)})._spans(str(folder / name))
    assert len(places) == 1 and (places[0].start > whole[0].start) == (name == "a.bam")


def test_no_records_and_broken_files(spark, tmp_path):
    bam.register(spark)
    write_bam(tmp_path / "empty.bam", [], 1_000, False)
    assert spark.read.format("bam").load(str(tmp_path / "empty.bam")).count() == 0
    write_bam(tmp_path / "cut.bam", sam_lines(5), 300, False)
    data = (tmp_path / "cut.bam").read_bytes()
    (tmp_path / "cut.bam").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut off|ends within"):
        spark.read.format("bam").load(str(tmp_path / "cut.bam")).collect()
