import gzip

from pyspark.sql import functions as F

from fragloom.operators import demux
from fragloom.operators.readclouds import read_clouds
from fragloom.sources import files, vcf
from fragloom.streaming.sessions import stream_read_clouds


def test_fastq_to_samples(spark, tmp_path):
    files.register(spark)
    bc = "ACGTACGTACGTACGT"
    for i in (1, 2):
        with gzip.open(tmp_path / f"r{i}.fastq.gz", "wt") as f:
            for n, (b, index) in enumerate([(bc, "AA"), (bc, "CC"), ("T" * 16, "AA"), (bc, "AN")]):
                f.write(f"@read{n} {i}:N:0:{index}\n{b if i == 1 else ''}GGG{n}\n+\n{'I' * (20 if i == 1 else 4)}\n")
    first, second = (spark.read.format("fastq").load(str(tmp_path / f"r{i}.fastq.gz")) for i in (1, 2))
    pairs = files.fastq_pairs(first, second)
    known, samples = spark.createDataFrame([(bc,)], "bc string"), spark.createDataFrame([("AA", "s1")], "bc string, sample string")
    out = demux.demultiplex(pairs, known, samples).collect()
    assert [(r.read_name, r["sample"], r.seq1, r.seq2) for r in out] == [(f"read0 BX:Z:{bc}", "s1", "GGG0", "GGG0")]
    assert demux.demultiplex(pairs, known, samples, keep_unmatched=True).count() == 2
    assert tuple(demux.demux_counts(pairs, known, samples).first()) == (3, 1, 1, 1)
    demux.write_by_sample(demux.demultiplex(pairs, known, samples, keep_unmatched=True), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("sample = 's1' AND read = 1").count() == 4


def test_fasta_bed_and_lists(spark, tmp_path):
    files.register(spark)
    (tmp_path / "r.fa").write_text(">c1 first\n" + "ACGTN" * 30_000 + "\n>c2\nNN\n")
    (tmp_path / "b.bed").write_text("#head\nc1\t5\t9\tx\nbad line\n")
    (tmp_path / "b.bedpe").write_text("chrom1\tstart1\tend1\tchrom2\tstart2\tend2\tname\nc1\t1\t2\tc2\t3\t4\tn\n")
    (tmp_path / "w.txt").write_text("AA\n\nCC \nAA\n")
    seq = {(r.chrom, r.bin): r.seq for r in spark.read.format("fasta").load(str(tmp_path / "r.fa")).collect()}
    assert {k: len(v) for k, v in seq.items()} == {("c1", 0): 100_000, ("c1", 1): 50_000, ("c2", 0): 2}
    assert [tuple(r) for r in files.read_bed(spark, str(tmp_path / "b.bed")).collect()] == [("c1", 5, 9, "x")]
    assert sorted(tuple(r) for r in files.read_bedpe(spark, str(tmp_path / "b.bedpe")).collect()) == [("c1", 1, 2, "n"), ("c2", 3, 4, "n")]
    assert sorted(r.bc for r in files.read_list(spark, str(tmp_path / "w.txt")).collect()) == ["AA", "CC"]


def test_sam_to_clouds(spark, tmp_path):
    sam = tmp_path / "a.sam"
    lines = ["@HD\tVN:1.6", "r1\t0\tc1\t101\t60\t10M2D5M50S\t=\t201\t150\tACGT\t*\tBX:Z:AAA-1,x\tHP:i:1\tPS:i:7", "r2\t1024\tc1\t111\t60\t10M\t*\t0\t0\tACGT\t*\tBX:Z:AAA-1", "r3\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*\tRX:Z:CCC", "r4\t16\tc1\t121\t60\t10M\t*\t0\t0\tACGT\t*\tRX:Z:AAA-1\tHP:i:2"]
    sam.write_text("\n".join(lines) + "\n")
    rows = files.read_sam(spark, str(sam))
    assert rows.where("chrom IS NULL").count() == 1
    assert rows.where("read_name = 'r1'").select(files.clipped_ends(F.col("cigar"))).first()[0] == ">"
    reads = files.as_reads(rows)
    assert {(r.read_name, r.bc, r.ref_end, r.hap) for r in reads.where("chrom IS NOT NULL").collect()} == {("r1", "AAA-1", 117, 1), ("r2", "AAA-1", 120, None), ("r4", "AAA-1", 130, None)}
    assert [tuple(r) for r in read_clouds(reads, 50).collect()] == [("c1", "AAA-1", 100, 130, 2, 30, 1)]


def test_vcf_files(spark, tmp_path):
    chroms = spark.createDataFrame([("c1", 1, 50), ("c0", 0, 90)], "chrom string, idx int, length bigint")
    rows = [(1, "c1", 9, "c0", 4, "+-", 3, True, None, 2, True), (2, "c1", 9, None, None, "+.", None, False, None, 0, None)]
    events = spark.createDataFrame(rows, "event_id bigint, chromx string, x bigint, chromy string, y bigint, orientation string, cluster bigint, assembled boolean, blacklist string, nearby_snvs bigint, frag_length_passes boolean")
    vcf.write_vcf(vcf.header(chroms, ["s"]), vcf.records(events, F.lit("1:9")), str(tmp_path / "v"))
    head = [r.value for r in spark.read.text(str(tmp_path / "v/header")).collect()]
    assert head[0] == "##fileformat=VCFv4.3" and head.index("##contig=<ID=c0,length=90>") < head.index("##contig=<ID=c1,length=50>")
    body = sorted(r.value.split("\t") for r in spark.read.text(str(tmp_path / "v/records")).collect())
    assert [b[:8] for b in body] == [["c0", "5", "1:1", "N", "]c1:10]N", "0", "PASS", "SVTYPE=BND;MATEID=1:0;ASSEMBLED;EVENT=3"], ["c1", "10", "1:0", "N", "N[c0:5[", "0", "PASS", "SVTYPE=BND;MATEID=1:1;ASSEMBLED;EVENT=3"]]


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [("c", "a", f"2024-01-01 00:{m:02d}:00", 60, False) for m in (0, 1, 30, 31, 59)]
    df = spark.createDataFrame(rows, "chrom string, bc string, t string, mapq int, is_duplicate boolean").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream_read_clouds(stream, "t", "10 minutes", "0 minutes").writeStream.format("memory").queryName("clouds").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.num_reads for r in spark.table("clouds").collect()) == [2, 2]  # the last one is still open
    assert sorted(r.num_reads for r in stream_read_clouds(df, "t", "10 minutes", "0 minutes").collect()) == [1, 2, 2]


def test_fasta_and_fastq_in_blocks_equal_the_readers_of_whole_files(spark, tmp_path):
    import random

    from fragloom.sources import files

    r = random.Random(5)
    files.register(spark)
    lines = []
    for c in range(7):
        lines.append(f">chr{c} some text")
        left = r.choice([0, 5, 2_000, 9_000])
        while left > 0:
            n = min(left, r.choice([1, 60, 3_000]))
            lines.append("".join(r.choices("ACGTN", k=n)))
            left -= n
    (tmp_path / "a.fa").write_text("\n".join(lines) + "\n")
    records = [(f"r{i}", "".join(r.choices("ACGT", k=20)), "".join(r.choices("@I+#", k=20))) for i in range(500)]
    for part in (0, 1):
        (tmp_path / f"{part}.fq").write_text("".join(f"@{n} 1:N:0:AC{part}\n{s}\n+\n{q}\n" for n, s, q in records[part::2]))
    want = {tuple(x) for x in spark.read.format("fasta").load(f"{tmp_path}/a.fa").collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert {tuple(x) for x in files.read_fasta(spark, f"{tmp_path}/a.fa").collect()} == want
            small = {}
            for x in files.read_fasta(spark, f"{tmp_path}/a.fa", 100).collect():
                assert len(x.seq) <= 100
                small.setdefault(x.chrom, {})[x.bin] = x.seq
            assert {c: "".join(own[b] for b in sorted(own)) for c, own in small.items()} == {c: s for c, _, s in want}
            got = sorted(map(tuple, files.read_fastq(spark, f"{tmp_path}/*.fq").collect()))
            assert got == [(i, n, f"AC{part}", s, q) for i, (part, n, s, q) in enumerate((p, *x) for p in (0, 1) for x in records[p::2])]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_places_on_the_contig(spark, tmp_path):
    from fragloom.sources import files

    rows = [("t", 0, "c", 101, 60, "60S100M5I50M2D10M70S"), ("t", 16, "d", 11, 60, "5H3S120M20H"), ("short", 0, "c", 1, 60, "45M"), ("none", 4, "*", 0, 0, "*")]
    (tmp_path / "x.sam").write_text("".join("\t".join(map(str, [*r, "*", 0, 0, "*", "*"])) + "\n" for r in rows))
    got = sorted(map(tuple, files.contig_alignments(files.read_sam(spark, str(tmp_path / "x.sam"))).collect()))
    # the second lies turned on the reference: what comes first there comes last on the contig
    assert got == [("t", "c", 100, 262, 60, 225, True, True), ("t", "d", 10, 130, 140, 20, False, False)]
