"""Read clouds over a stream: an extension, for reads that arrive by position in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_read_clouds(reads: DataFrame, time: str, gap: str, late: str, by: tuple[str, ...] = ("chrom", "bc"), one_mapq: int = 60) -> DataFrame:
    """(by, start_time, end_time, num_reads): sessions of a barcode's reads that are less than ``gap`` apart, closed once the watermark has passed.

    Works on streams and on tables alike. The rules on the first and last read of a cloud need its reads in order and are
    left to the batch operator; sessions without a read of ``one_mapq`` are dropped. Reads later than ``late`` are ignored.
    """
    good = reads.where("bc IS NOT NULL AND chrom IS NOT NULL AND NOT is_duplicate").withWatermark(time, late)
    sessions = good.groupBy(*by, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("num_reads"), F.max("mapq").alias("_best"), F.min(time).alias("start_time"), F.max(time).alias("end_time"))
    return sessions.where(F.col("_best") >= one_mapq).select(*by, "start_time", "end_time", "num_reads")
