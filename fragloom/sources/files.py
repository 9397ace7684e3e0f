"""Readers of the text formats of sequencing: FASTQ, FASTA, BED, SAM and lists, plain or compressed as Spark's text reader knows them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition



def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(bc): the distinct lines that are not empty."""
    return spark.read.text(path).select(F.trim("value").alias("bc")).where("bc <> ''").distinct()


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start_pos, end_pos, reason) of a BED file; lines of headers and without numbers are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("NOT startswith(value, '#')").select(F.get(f, F.lit(0)).alias("chrom"), F.try_to_number(F.get(f, F.lit(1)), F.lit("999999999999")).cast("bigint").alias("start_pos"), F.try_to_number(F.get(f, F.lit(2)), F.lit("999999999999")).cast("bigint").alias("end_pos"), F.get(f, F.lit(3)).alias("reason"))
    return rows.where("start_pos IS NOT NULL AND end_pos IS NOT NULL")


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    """The same of both sides of a BEDPE file: one row for each side."""
    f = F.split("value", "\t")
    number = lambda i: F.try_to_number(F.get(f, F.lit(i)), F.lit("999999999999")).cast("bigint")
    side = lambda i: F.struct(F.get(f, F.lit(i)).alias("chrom"), number(i + 1).alias("start_pos"), number(i + 2).alias("end_pos"), F.get(f, F.lit(6)).alias("reason"))
    return spark.read.text(path).select(F.inline(F.array(side(0), side(3)))).where("start_pos IS NOT NULL AND end_pos IS NOT NULL")


def cigar(text: Column) -> Column:
    """``76M2D`` as an array of (len, op)."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"\d+", 0).cast("bigint").alias("len"), F.right(p, F.lit(1)).alias("op")))


def reference_end(pos: Column, operations: Column) -> Column:
    """Where an alignment ends on the reference."""
    return pos + F.aggregate(F.filter(operations, lambda o: o["op"].isin("M", "D", "N", "=", "X")), F.lit(0).cast("bigint"), lambda n, o: n + o["len"])


def clipped_ends(operations: Column, more_than: int = 40) -> Column:
    """``<`` and ``>`` for more than so many unaligned bases before and after the alignment."""
    clip = lambda o: F.when(o["op"].isin("S", "H") & (o["len"] > more_than), True).otherwise(False)
    first, last = F.get(operations, F.lit(0)), F.get(operations, F.size(operations) - 1)
    return F.concat(F.when(F.coalesce(clip(first), F.lit(False)), "<").otherwise(""), F.when((F.size(operations) > 1) & F.coalesce(clip(last), F.lit(False)), ">").otherwise(""))


def query_span(operations: Column, reverse: Column) -> Column:
    """struct(q_start, q_end, q_length): which bases of the sequence, as it was read, an alignment takes; clipped ones lie before and after."""
    total = lambda ops: F.aggregate(ops, F.lit(0).cast("bigint"), lambda n, o: n + o["len"])
    is_clip = lambda o: o["op"].isin("S", "H")
    count = F.size(operations)
    # clips at the start are those before the first operation that is none
    first_inner = F.array_position(F.transform(operations, lambda o: ~is_clip(o)), True)
    left = total(F.filter(operations, lambda o, i: is_clip(o) & (i + 1 < first_inner)))
    right = total(F.filter(operations, lambda o, i: is_clip(o) & (i + 1 > first_inner)))
    inner = total(F.filter(operations, lambda o: o["op"].isin("M", "I", "=", "X")))
    start = F.when(reverse, right).otherwise(left)
    return F.when((count > 0) & (first_inner > 0), F.struct(start.alias("q_start"), (start + inner).alias("q_end"), (left + inner + right).alias("q_length")))


def contig_alignments(alignments: DataFrame, min_length: int = 45, more_than: int = 40) -> DataFrame:
    """(contig, chrom, start, end, q_start, q_end, clip_left, clip_right): the alignments of contigs of more than ``min_length`` bases on the reference, as walks take them.

    ``alignments`` are rows of ``read_sam`` whose read names are the contigs. Coordinates on the contig run from its start as it
    was read; ``q_start`` is that of the alignment's start on the reference, so it is the greater one where it is turned.
    """
    span = query_span(F.col("cigar"), F.col("flag").bitwiseAND(F.lit(16)) != 0)
    rows = alignments.where("chrom IS NOT NULL").withColumns({"_end": reference_end(F.col("pos"), F.col("cigar")), "_q": span, "_clips": clipped_ends(F.col("cigar"), more_than), "_turned": F.col("flag").bitwiseAND(F.lit(16)) != 0})
    kept = rows.where((F.col("_end") - F.col("pos") > min_length) & F.col("_q").isNotNull())
    return kept.select(
        F.col("read_name").alias("contig"), "chrom", F.col("pos").alias("start"), F.col("_end").alias("end"), F.when(F.col("_turned"), F.col("_q.q_end")).otherwise(F.col("_q.q_start")).alias("q_start"),
        F.when(F.col("_turned"), F.col("_q.q_start")).otherwise(F.col("_q.q_end")).alias("q_end"), F.contains("_clips", F.lit("<")).alias("clip_left"), F.contains("_clips", F.lit(">")).alias("clip_right"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM file with 0-based positions; an unmapped read has no chrom."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    known = lambda c: F.when(c != "*", c)
    tag = lambda name: F.regexp_extract(F.element_at(F.filter(f, lambda x: F.startswith(x, F.lit(name + ":"))), 1), r"^..:.:(.*)$", 1)
    some = lambda name: F.when(F.exists(f, lambda x: F.startswith(x, F.lit(name + ":"))), tag(name))
    rows = spark.read.text(path).where("NOT startswith(value, '@') AND value <> ''")
    mate = F.when(at(6) == "=", at(2)).otherwise(known(at(6)))
    return rows.select(
        at(0).alias("read_name"), at(1).cast("int").alias("flag"), known(at(2)).alias("chrom"), (at(3).cast("bigint") - 1).alias("pos"), at(4).cast("int").alias("mapq"), cigar(at(5)).alias("cigar"),
        mate.alias("next_chrom"), (at(7).cast("bigint") - 1).alias("next_pos"), at(8).cast("bigint").alias("insert_size"), at(9).alias("seq"),
        some("BX").alias("bx"), some("RX").alias("rx"), some("HP").cast("int").alias("hp"), some("PS").cast("bigint").alias("ps"),
    )


def as_reads(sam: DataFrame) -> DataFrame:
    """SAM rows as the reads of the read-cloud operators: BX, else RX, as barcode; flags as columns; haplotype only with a phase set."""
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    bc = F.substring_index(F.coalesce("bx", "rx"), ",", 1)
    return sam.select("read_name", F.xxhash64("read_name", "flag").alias("read_id"), "chrom", bc.alias("bc"), "pos", reference_end(F.col("pos"), F.col("cigar")).alias("ref_end"), "mapq", bit(1024).alias("is_duplicate"), bit(256).alias("is_secondary"), bit(2048).alias("is_supplementary"), bit(16).alias("is_reverse"), F.when(F.col("ps").isNotNull(), F.col("hp")).alias("hap"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, i, line, value): the lines of text files with their numbers from 0 in each file.

    Files are read in blocks by many tasks, as Spark's text reader splits them (compressed ones are one block); lines are
    counted in their block first and the blocks' counts added up, of which there is one row for each.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    blocks = rows.groupBy("file", "block").agg(F.min("i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "_first", before.alias("_before"))
    return rows.join(blocks, ["file", "block"]).select("file", "block", "i", (F.col("i") - F.col("_first") + F.col("_before")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(n, read_name, sample_bc, seq, qual) of files of four lines a record, read in blocks; n counts the records over all files in the order of their names."""
    lines = numbered_lines(spark, path)
    at = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    records = lines.groupBy("file", F.expr("line div 4").alias("record")).agg(at(0).alias("name"), at(1).alias("seq"), at(3).alias("qual")).where("qual IS NOT NULL")
    files = lines.groupBy("file").agg(F.expr("(max(line) + 1) div 4").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before.alias("_before"))
    name = F.regexp_replace("name", "^@", "")
    return records.join(files, "file").select((F.col("record") + F.col("_before")).alias("n"), F.substring_index(name, " ", 1).alias("read_name"), F.when(F.contains("name", F.lit(":")), F.substring_index("name", ":", -1)).alias("sample_bc"), "seq", "qual")


def read_fasta(spark: SparkSession, path: str, size: int = 100_000) -> DataFrame:
    """(chrom, bin, seq): references in pieces of ``size`` bases, read in blocks; a chromosome goes on over any number of them.

    Places are counted within a block first; a block hands on its last chromosome and how far it has come, one row each.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value"))
    head = F.startswith("value", F.lit(">"))
    lines = lines.withColumns({"_name": F.when(head, F.coalesce(F.nullif(F.regexp_extract("value", r"^>\s*(\S+)", 1), F.lit("")), F.lit(""))), "_len": F.when(head, 0).otherwise(F.length("value")).cast("bigint")})
    w = Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    local = lines.withColumns({"_part": F.count("_name").over(w), "_chrom": F.last("_name", ignorenulls=True).over(w)})
    inside = Window.partitionBy("file", "block", "_part").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    local = local.withColumn("_at", F.coalesce(F.sum("_len").over(inside), F.lit(0)))
    # what a block hands on: its last name, if it has one, and the bases after that
    tails = lines.groupBy("file", "block").agg(F.max_by("_name", F.when(F.col("_name").isNotNull(), F.col("i"))).alias("name"))
    parts = local.groupBy("file", "block", "_part").agg(F.sum("_len").alias("n")).groupBy("file", "block").agg(F.max_by("n", "_part").alias("n"))
    tails = tails.join(parts, ["file", "block"])
    order = Window.partitionBy("file").orderBy("block")
    tails = tails.withColumns({"_in": F.last("name", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "_run": F.count("name").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_own": F.count("name").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    # the bases of the same chromosome in the blocks before
    done = tails.select("file", F.col("block").alias("_b"), F.col("_own").alias("_run"), "n")
    carried = tails.select("file", "block", "_in", "_run").join(done, ["file", "_run"]).where("_b < block").groupBy("file", "block").agg(F.sum("n").alias("_before"))
    known = tails.select("file", "block", "_in").join(carried, ["file", "block"], "left")
    rows = local.where("_name IS NULL AND _len > 0").join(known, ["file", "block"])
    first = F.col("_part") == 0
    placed = rows.select(F.when(first, F.col("_in")).otherwise(F.col("_chrom")).alias("chrom"), (F.col("_at") + F.when(first, F.coalesce("_before", F.lit(0))).otherwise(F.lit(0))).alias("_start"), "value")
    # long lines in parts first, so that none is gone through again for each piece
    cut = placed.select("chrom", "_start", F.posexplode(F.regexp_extract_all("value", F.lit(f".{{1,{size}}}"), F.lit(0))).alias("_k", "_s")).withColumn("_start", F.col("_start") + F.col("_k") * size)
    bins = F.explode(F.sequence(F.expr(f"_start div {size}"), F.expr(f"(_start + length(_s) - 1) div {size}"))).alias("bin")
    low, high = F.greatest(F.col("_start"), F.col("bin") * size), F.least(F.col("_start") + F.length("_s"), (F.col("bin") + 1) * size)
    pieces = cut.select("chrom", "_start", "_s", bins).select("chrom", "bin", low.alias("_low"), F.substr("_s", (low - F.col("_start") + 1).cast("int"), (high - low).cast("int")).alias("_s"))
    return pieces.groupBy("chrom", "bin").agg(F.array_sort(F.collect_list(F.struct("_low", "_s"))).alias("_p")).select("chrom", "bin", F.array_join(F.col("_p._s"), "").alias("seq"))


class _Records(DataSourceReader):
    """Files of records that only make sense in the order of their lines: one task for each file, one record at a time."""

    def __init__(self, options: dict, kind: str):
        self.paths, self.kind = options["path"].split(","), kind

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for path in self.paths for p in sorted(glob.glob(path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import bz2
        import gzip
        import lzma

        path = partition.value
        opener = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}.get(path.rsplit(".", 1)[-1], open)
        with opener(path, "rt") as lines:
            yield from (self._fastq if self.kind == "fastq" else self._fasta)(lines)

    @staticmethod
    def _fastq(lines: Iterator[str]) -> Iterator[tuple]:
        four = zip(*[(line.rstrip("\n") for line in lines)] * 4)
        for n, (name, seq, _, qual) in enumerate(four):
            yield n, name[1:].split(" ")[0], name.rsplit(":", 1)[-1] if ":" in name else None, seq, qual

    @staticmethod
    def _fasta(lines: Iterator[str], size: int = 100_000) -> Iterator[tuple]:
        chrom, held, n, at = None, [], 0, 0
        for line in lines:
            line = line.strip()
            if line.startswith(">"):
                if held:
                    yield chrom, at, "".join(held)
                chrom, held, n, at = line[1:].split()[0] if line[1:].split() else "", [], 0, 0
                continue
            first = 0
            while n + len(line) - first >= size:
                held.append(line[first : first + size - n])
                yield chrom, at, "".join(held)
                first, held, n, at = first + size - n, [], 0, at + 1
            if first < len(line):
                held.append(line[first:])
                n += len(line) - first
        if held:
            yield chrom, at, "".join(held)


class FastqSource(DataSource):
    """``spark.read.format("fastq")``: (n, read_name, sample_bc, seq, qual) of files of four lines a record, .gz, .bz2 and .xz as well."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "n bigint, read_name string, sample_bc string, seq string, qual string"

    def reader(self, schema) -> _Records:  # type: ignore[no-untyped-def]
        return _Records(self.options, "fastq")


class FastaSource(DataSource):
    """``spark.read.format("fasta")``: (chrom, bin, seq), a reference in pieces of 100,000 bases."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "chrom string, bin bigint, seq string"

    def reader(self, schema) -> _Records:  # type: ignore[no-untyped-def]
        return _Records(self.options, "fasta")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(FastaSource)


def fastq_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of records of the same place in two files, as the demultiplexing operators take them."""
    a = first.select("n", "read_name", "sample_bc", F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    return a.join(second.select("n", F.col("seq").alias("seq2"), F.col("qual").alias("qual2")), "n").drop("n")
