"""The spellings of barcodes and chromosomes, and what counts as a fragment, an interval or a measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_A_LENGTH_FROM = 500_000_000


def barcode(bc: Column) -> Column:
    """Text before the first comma, trimmed, upper case, without a final ``-digits``; null where nothing or only N is left."""
    clean = F.regexp_replace(F.upper(F.btrim(F.substring_index(bc, ",", 1), F.lit(" \t\r\n"))), "-[0-9]+$", "")
    return F.when(~clean.rlike("^N*$"), clean)


def barcode_tag(bx: Column, rx: Column) -> Column:
    """The barcode of a read: BX, else RX, up to the first comma."""
    return F.substring_index(F.coalesce(bx, rx), ",", 1)


def chromosome_names(chroms: DataFrame) -> DataFrame:
    """(spelling, name): every way in which a chromosome may be written; a spelling of two chromosomes means the first by idx."""
    return (
        chroms.select("idx", F.col("chrom").alias("name"), F.explode(F.array("chrom", "alias_name", "accession")).alias("spelling"))
        .where("spelling is not null")
        .groupBy("spelling")
        .agg(F.min_by("name", "idx").alias("name"))
    )


def with_chromosome(df: DataFrame, chroms: DataFrame, *columns: str) -> DataFrame:
    """Replaces each column by the chromosome it names; an unknown spelling stays as it is, null stays null.

    ``chroms`` is the fixed reference dimension. No hint is given: Spark broadcasts it while it is under its threshold.
    """
    names = chromosome_names(chroms)
    for c in columns:
        known = names.select(F.col("spelling").alias("_spelling"), F.col("name").alias("_name"))
        df = df.join(known, df[c] == F.col("_spelling"), "left").withColumn(c, F.coalesce("_name", c)).drop("_spelling", "_name")
    return df


def usable(start: str = "start_pos", end: str = "end_pos") -> Column:
    """Both coordinates present and the interval not empty."""
    return F.coalesce(F.col(end) > F.col(start), F.lit(False))


def measurement(c: Column) -> Column:
    """The value as a measurement; null where it is null, negative or absurdly large."""
    return F.when((c >= 0) & (c < NOT_A_LENGTH_FROM), c)


def distinct_fragments(fragments: DataFrame, *columns: str) -> DataFrame:
    """One row per ``frag_id`` with the given columns; ``bc`` comes normalised.

    Rows of a fragment differ in ``delivered_at`` and in the spelling of the barcode alone, so the distinct normalised
    rows are the fragments; a plain distinct hashes evenly, whichever barcode or dataset is hot. Rows without
    ``frag_id`` can't be told apart and count as distinct rows.
    """
    keep = ["frag_id", *[c for c in columns if c != "frag_id"]]
    return fragments.select(*[barcode(F.col("bc")).alias("bc") if c == "bc" else F.col(c) for c in keep]).distinct()
