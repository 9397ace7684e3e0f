"""Scalar expressions on sequences, breakends and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters other than ACGT, in either case, stay."""
    return F.translate(F.reverse(seq), "ATCGatcg", "TAGCtagc")


def breakend_label(chrom: Column, pos: Column, orientation: Column) -> Column:
    """``chrom:1,234+``"""
    return F.concat(chrom, F.lit(":"), F.format_number(pos, 0), orientation)


def breakend_from_label(label: Column) -> Column:
    """struct(chrom, pos, orientation) of a label; nulls where it is none."""
    pattern = r"^(.*):([0-9,]+)([+-])$"
    part = lambda i: F.nullif(F.regexp_extract(label, pattern, i), F.lit(""))
    return F.struct(part(1).alias("chrom"), F.regexp_replace(part(2), ",", "").cast("bigint").alias("pos"), part(3).alias("orientation"))


def facing(chromx: Column, x: Column, ox: Column, chromy: Column, y: Column, oy: Column, near: int = 100_000, bad: int = 1_000) -> Column:
    """How two breakends lie: ``facing`` if the left one opens to the right and the right one to the left within ``near``, ``bad`` if that within ``bad``, else ``breakpoint``."""
    left = F.when(x <= y, ox).otherwise(oy)
    right = F.when(x <= y, oy).otherwise(ox)
    apart = F.abs(x - y)
    towards = (chromx == chromy) & (apart < near) & (left == "-") & (right == "+")
    return F.when(towards & (apart < bad), "bad").when(towards, "facing").otherwise("breakpoint")


def natural_key(name: str) -> list:
    """Sort key in which s2 comes before s10."""
    return [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name)]


def percent(n: Column, total: Column) -> Column:
    """``12 (34.5%)``; just the number where the total is 0."""
    return F.when(total > 0, F.format_string("%d (%.1f%%)", n.cast("bigint"), n * 100.0 / total)).otherwise(F.format_string("%d", n.cast("bigint")))
