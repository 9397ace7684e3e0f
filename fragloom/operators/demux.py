"""Barcodes and samples of raw read pairs, and the bookkeeping of a demultiplexing run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BARCODE = 16


def trim(seq: Column, qual: Column, length: int = BARCODE) -> Column:
    """struct(bc, seq, qual): the barcode is the first ``length`` letters, the rest is the read."""
    return F.struct(F.left(seq, F.lit(length)).alias("bc"), F.substr(seq, F.lit(length + 1)).alias("seq"), F.substr(qual, F.lit(length + 1)).alias("qual"))


def demultiplex(pairs: DataFrame, whitelist: DataFrame, samples: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """``pairs`` (read_name, sample_bc, seq1, qual1, seq2, qual2) with bc and sample, barcode trimmed from the first read.

    Pairs whose barcode is not in ``whitelist`` (bc) are out; so are those with an unknown sample index in ``samples``
    (bc, sample), unless ``keep_unmatched``, which leaves their sample null. Records whose index holds an N are skipped.
    """
    rows = pairs.where(~F.contains("sample_bc", F.lit("N"))).withColumn("_t", trim(F.col("seq1"), F.col("qual1")))
    rows = rows.withColumns({"bc": F.col("_t.bc"), "seq1": F.col("_t.seq"), "qual1": F.col("_t.qual")}).drop("_t")
    known = rows.join(whitelist.select("bc").distinct(), "bc", "left_semi")
    names = samples.select(F.col("bc").alias("sample_bc"), "sample").dropDuplicates(["sample_bc"])
    return known.join(names, "sample_bc", "left" if keep_unmatched else "inner").withColumn("read_name", F.concat("read_name", F.lit(" BX:Z:"), "bc"))


def demux_counts(pairs: DataFrame, whitelist: DataFrame, samples: DataFrame) -> DataFrame:
    """(total, good, bad_gem, bad_sample): pairs, those that pass, those with an unknown barcode, and the others with an unknown index."""
    gem = whitelist.select(F.col("bc").alias("_g")).distinct()
    names = samples.select(F.col("bc").alias("_i")).distinct()
    rows = pairs.where(~F.contains("sample_bc", F.lit("N"))).select("sample_bc", F.left("seq1", F.lit(BARCODE)).alias("bc"))
    marked = rows.join(gem, F.col("bc") == F.col("_g"), "left").join(names, F.col("sample_bc") == F.col("_i"), "left")
    ok, named = F.col("_g").isNotNull(), F.col("_i").isNotNull()
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok & named).alias("good"), F.count_if(~ok).alias("bad_gem"), F.count_if(ok & ~named).alias("bad_sample"))


def index_shares(pairs: DataFrame, samples: DataFrame, fair: float = 0.1) -> DataFrame:
    """(sample_bc, n, share, known, warn): pairs of every sample index, and a warning where an index that no sample has holds more than ``fair`` of what each sample would have."""
    names = samples.select(F.col("bc").alias("sample_bc")).distinct().withColumn("known", F.lit(True))
    rows = pairs.where(~F.contains("sample_bc", F.lit("N")))
    counts = rows.groupBy("sample_bc").agg(F.count(F.lit(1)).alias("n")).join(names, "sample_bc", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    # one row each, held against all
    total = counts.agg(F.sum("n").alias("_total")).withColumn("_k", F.lit(1))
    n_samples = names.agg(F.count(F.lit(1)).alias("_samples")).withColumn("_k", F.lit(1))
    both = counts.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").join(F.broadcast(n_samples), "_k")
    warn = ~F.col("known") & (F.col("n") > F.try_divide("_total", F.col("_samples")) * fair)
    return both.select("sample_bc", "n", (F.col("n") / F.col("_total")).alias("share"), "known", F.coalesce(warn, F.lit(False)).alias("warn"))


def write_by_sample(demultiplexed: DataFrame, path: str) -> None:
    """FASTQ records of both reads under one folder for each sample and read, gzipped; unmatched ones under ``sample=unmatched``."""
    record = lambda i: F.concat_ws("\n", F.concat(F.lit("@"), "read_name"), f"seq{i}", F.lit("+"), f"qual{i}")
    both = demultiplexed.select(F.coalesce("sample", F.lit("unmatched")).alias("sample"), F.inline(F.array(*[F.struct(F.lit(i).alias("read"), record(i).alias("value")) for i in (1, 2)])))
    both.write.mode("overwrite").partitionBy("sample", "read").option("compression", "gzip").text(path)
