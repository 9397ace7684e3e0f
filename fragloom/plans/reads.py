"""Queries on reads (the stream of events, a user being a barcode) and on what is built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom.operators import readclouds as rc
from fragloom.operators.evidence import covered_bases
from fragloom.plans.tables import table

DAY = 86_400


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pos = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    # reads of many lengths, so that one of low quality may reach beyond all others
    mapq = F.expr("CASE WHEN event_id % 10 = 0 THEN 20 WHEN event_id % 10 < 3 THEN 45 ELSE 60 END")
    return e.select(
        F.col("event_id").alias("read_id"), F.col("event_type").alias("chrom"), F.col("user_id").cast("string").alias("bc"), pos.alias("pos"), (pos + 100 + F.col("event_id") % 7 * 9_000).alias("ref_end"),
        mapq.alias("mapq"), (F.col("event_id") % 50 == 7).alias("is_duplicate"), F.when(F.col("event_id") % 7 > 1, F.col("event_id") % 3).alias("hap"),
    )


def read_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.read_clouds(reads(spark, sf_dir), DAY)


def inter_read_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by their distance to the one before."""
    return rc.inter_read_distances(reads(spark, sf_dir)).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


def clustering_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.clustering_distance(rc.inter_read_distances(reads(spark, sf_dir)))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.barcode_totals(read_clouds(spark, sf_dir))


def barcode_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir)


def good_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.good_barcodes(_totals(spark, sf_dir))


def barcode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.barcode_ids(read_clouds(spark, sf_dir))


def combined_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clouds of good barcodes."""
    return rc.combine_read_clouds([read_clouds(spark, sf_dir)])


def cloud_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of each cloud under at least one of its barcode's reads."""
    r = reads(spark, sf_dir)
    return covered_bases(rc.read_clouds(r, DAY), rc.good_reads(r), ["chrom", "bc", "start_pos"])


def sampling_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the reads that distances are sampled from; reads are first or second, and some secondary, by their number."""
    n = F.col("read_id")
    flag = F.when(n % 2 == 1, 64).otherwise(128) + F.when(n % 17 == 0, 256).otherwise(0) + F.when(n % 19 == 0, 2048).otherwise(0)
    kept = rc.sampling_reads(reads(spark, sf_dir).withColumn("flag", flag)).withColumn("is_duplicate", F.lit(False))
    return rc.inter_read_distances(kept).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {q.__name__: q for q in (sampling_distances, cloud_coverage, read_clouds, inter_read_distance, clustering_distance, barcode_totals, good_barcodes, barcode_ids, combined_clouds)}

_READS = """reads AS (SELECT event_id AS read_id, event_type AS chrom, CAST(user_id AS VARCHAR) AS bc, date_diff('second', timestamp '2024-01-01', ts) AS pos,
  date_diff('second', timestamp '2024-01-01', ts) + 100 + event_id % 7 * 9000 AS ref_end, CASE WHEN event_id % 10 = 0 THEN 20 WHEN event_id % 10 < 3 THEN 45 ELSE 60 END AS mapq, CASE WHEN event_id % 7 > 1 THEN event_id % 3 END AS hap
  FROM events WHERE event_id % 50 <> 7 AND event_type IS NOT NULL AND user_id IS NOT NULL)"""
_CLOUDS = f"""WITH {_READS},
lagged AS (SELECT *, CASE WHEN pos - lag(ref_end) OVER w > {DAY} THEN 1 ELSE 0 END AS brk, row_number() OVER w AS place FROM reads WINDOW w AS (PARTITION BY chrom, bc ORDER BY pos, read_id)),
numbered AS (SELECT *, sum(brk) OVER (PARTITION BY chrom, bc ORDER BY pos, read_id ROWS UNBOUNDED PRECEDING) AS cloud FROM lagged),
bounds AS (SELECT chrom, bc, cloud, min(place) FILTER (mapq > 30) AS a, max(place) FILTER (mapq >= 30) AS b, max(mapq) AS best FROM numbered GROUP BY ALL),
clouds AS (SELECT chrom, bc, min(pos) AS start_pos, max(ref_end) AS end_pos, count(*) AS num_reads, max(ref_end) - min(pos) AS obs_len, max(CASE WHEN place = a THEN hap END) AS hap
  FROM numbered JOIN bounds USING (chrom, bc, cloud) WHERE best >= 60 AND place BETWEEN a AND b GROUP BY chrom, bc, cloud),
totals AS (SELECT bc, CAST(sum(num_reads) AS BIGINT) AS num_reads FROM clouds GROUP BY bc),
running AS (SELECT *, sum(num_reads) OVER (ORDER BY num_reads DESC, bc ROWS UNBOUNDED PRECEDING) AS upto, sum(num_reads) OVER () AS total FROM totals),
good AS (SELECT bc, num_reads FROM running WHERE upto < total * 0.9)"""
_DISTANCES = f"WITH {_READS}, d AS (SELECT pos - lag(pos) OVER (PARTITION BY chrom, bc ORDER BY pos, read_id) AS distance FROM reads), near AS (SELECT distance FROM d WHERE distance < 60000)"
SQL = {
    "sampling_distances": f"""WITH {_READS.replace("event_id % 50 <> 7 AND ", "")}, d AS (SELECT pos - lag(pos) OVER (PARTITION BY chrom, bc ORDER BY pos, read_id) AS distance FROM reads WHERE read_id % 2 = 1 AND read_id % 17 <> 0 AND read_id % 19 <> 0) SELECT distance, count(*) AS n FROM d WHERE distance < 60000 GROUP BY distance""",
    "cloud_coverage": f"""{_CLOUDS}, hits AS (SELECT c.chrom, c.bc, c.start_pos, greatest(pos, c.start_pos) AS s, least(ref_end, end_pos) AS e FROM clouds c JOIN reads r ON r.chrom = c.chrom AND r.bc = c.bc AND pos < end_pos AND ref_end > c.start_pos),
seen AS (SELECT *, max(e) OVER (PARTITION BY chrom, bc, start_pos ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits) SELECT chrom, bc, start_pos, CAST(sum(greatest(0, e - greatest(s, coalesce(before, s)))) AS BIGINT) AS covered FROM seen GROUP BY ALL""",
    "read_clouds": f"{_CLOUDS} SELECT * FROM clouds",
    "inter_read_distance": f"{_DISTANCES} SELECT distance, count(*) AS n FROM near GROUP BY distance",
    "clustering_distance": f"{_DISTANCES} SELECT CAST(greatest(10000, ceil(p / 5000) * 5000) AS BIGINT) AS distance, p AS p99 FROM (SELECT quantile_cont(distance, 0.99) AS p FROM near)",
    "barcode_totals": f"{_CLOUDS} SELECT * FROM totals",
    "good_barcodes": f"{_CLOUDS} SELECT * FROM good",
    "barcode_ids": f"{_CLOUDS} SELECT bc, row_number() OVER (ORDER BY bc) - 1 AS id FROM (SELECT DISTINCT bc FROM clouds)",
    "combined_clouds": f"{_CLOUDS} SELECT * FROM clouds WHERE bc IN (SELECT bc FROM good)",
}
