"""The given tables in normalised form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom.functions.conventions import barcode, distinct_fragments, with_chromosome
from fragloom.operators.tips import Tips


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fragments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct fragments with the given columns; ``bc`` and ``chrom`` normalised."""
    out = distinct_fragments(table(spark, sf_dir, "fragments"), *columns)
    return with_chromosome(out, table(spark, sf_dir, "chroms"), "chrom") if "chrom" in columns else out


def tips(spark: SparkSession, sf_dir: str) -> Tips:
    """The tips of all fragments; those drop repeated rows themselves, so that no other shuffle has to."""
    rows = table(spark, sf_dir, "fragments").select("frag_id", "dataset", "chrom", "start_pos", "end_pos", barcode(F.col("bc")).alias("bc"), "hap")
    return Tips(with_chromosome(rows, table(spark, sf_dir, "chroms"), "chrom"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``genotypes`` with both chromosomes normalised."""
    return with_chromosome(table(spark, sf_dir, "genotypes"), table(spark, sf_dir, "chroms"), "chromx", "chromy")
