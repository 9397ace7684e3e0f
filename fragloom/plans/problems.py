"""Queries of problems 1 and 4 over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom.functions.conventions import barcode, usable, with_chromosome
from fragloom.operators.coverage import coverage_gaps, merge_intervals
from fragloom.operators.heavy_keys import dominant_keys, join_aggregate, key_loads
from fragloom.plans.tables import fragments, genotypes, table

ENTITY = ["dataset", "chrom", "bc"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_keys(fragments(spark, sf_dir, "dataset", "bc", "num_reads"), ["dataset"], "bc", "num_reads").select("dataset", "bc")


def p1_barcode_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments and reads of every (dataset, barcode), beside those of its dataset."""
    loads = key_loads(fragments(spark, sf_dir, "dataset", "bc", "num_reads"), ["dataset"], "bc", "num_reads")
    return loads.select("dataset", "bc", F.col("rows").alias("n_fragments"), F.col("sum_num_reads").alias("n_reads"), F.col("outer_rows").alias("dataset_fragments"), F.col("outer_sum").alias("dataset_reads"))


def p1_event_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset and kind of event: the (event, fragment) pairs that share dataset and chromosome, and both sides' sums over them."""
    f = fragments(spark, sf_dir, "dataset", "chrom", "num_reads")
    g = genotypes(spark, sf_dir).select("dataset", F.col("chromx").alias("chrom"), F.lower("kind").alias("kind"), "shared")
    out = join_aggregate(f, g, ["dataset", "chrom"], ["dataset"], ["kind"], ["num_reads"], ["shared"])
    return out.select("dataset", "kind", *[F.col(a).cast("bigint").alias(b) for a, b in (("pairs", "pairs"), ("left_num_reads_sum", "reads"), ("right_shared_sum", "shared"))])


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable intervals with a barcode; repeated deliveries stay, as they cover nothing more."""
    f = table(spark, sf_dir, "fragments").where(usable()).select("dataset", "chrom", barcode(F.col("bc")).alias("bc"), "start_pos", "end_pos")
    return with_chromosome(f.where("bc is not null"), table(spark, sf_dir, "chroms"), "chrom")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_gaps(_intervals(spark, sf_dir), ENTITY)


def p4_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_intervals(_intervals(spark, sf_dir), ENTITY)


QUERIES = {q.__name__: q for q in (p1_found, p1_barcode_load, p1_event_fragments, p4_found, p4_stretches)}

#: Barcode and chromosome by the conventions, and one row per fragment.
FRAGMENTS_SQL = """
names AS (SELECT spelling, min_by(chrom, idx) AS name FROM (SELECT chrom, idx, unnest([chrom, alias_name, accession]) AS spelling FROM chroms) GROUP BY spelling),
spelled AS (SELECT * REPLACE (regexp_replace(upper(trim(split_part(bc, ',', 1))), '-[0-9]+$', '') AS bc) FROM fragments),
frags AS (SELECT DISTINCT frag_id, sample, dataset, coalesce(n.name, f.chrom) AS chrom, start_pos, end_pos, CASE WHEN NOT regexp_matches(bc, '^N*$') THEN bc END AS bc, num_reads, obs_len, hap, run_day
          FROM spelled f LEFT JOIN names n ON n.spelling = f.chrom)
"""
_LOADS = f"""WITH {FRAGMENTS_SQL}, loads AS (SELECT dataset, bc, count(*) AS n, coalesce(sum(num_reads), 0) AS r FROM frags WHERE bc IS NOT NULL GROUP BY dataset, bc),
totals AS (SELECT dataset, count(*) AS n, coalesce(sum(num_reads), 0) AS r FROM frags WHERE bc IS NOT NULL GROUP BY dataset)"""
_MARKED = f"""WITH {FRAGMENTS_SQL}, iv AS (SELECT dataset, chrom, bc, start_pos AS s, end_pos AS e FROM frags WHERE bc IS NOT NULL AND end_pos > start_pos),
marked AS (SELECT *, max(e) OVER (PARTITION BY dataset, chrom, bc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv)"""
SQL = {
    "p1_found": f"{_LOADS} SELECT l.dataset, l.bc FROM loads l JOIN totals t USING (dataset) WHERE l.n * 50 >= t.n OR l.r * 50 >= t.r",
    "p1_barcode_load": f"{_LOADS} SELECT l.dataset, l.bc, l.n AS n_fragments, CAST(l.r AS BIGINT) AS n_reads, t.n AS dataset_fragments, CAST(t.r AS BIGINT) AS dataset_reads FROM loads l JOIN totals t USING (dataset)",
    "p1_event_fragments": f"""WITH {FRAGMENTS_SQL}, g AS (SELECT dataset, coalesce(n.name, chromx) AS chrom, lower(kind) AS kind, shared FROM genotypes LEFT JOIN names n ON n.spelling = chromx)
SELECT f.dataset, g.kind, count(*) AS pairs, CAST(sum(coalesce(num_reads, 0)) AS BIGINT) AS reads, CAST(sum(coalesce(shared, 0)) AS BIGINT) AS shared FROM frags f JOIN g ON g.dataset = f.dataset AND g.chrom = f.chrom GROUP BY f.dataset, g.kind""",
    "p4_found": f"{_MARKED} SELECT dataset, chrom, bc, reach AS gap_start, s AS gap_end FROM marked WHERE s > reach",
    "p4_stretches": f"""{_MARKED}, grouped AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, chrom, bc ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT dataset, chrom, bc, min(s) AS stretch_start, max(e) AS stretch_end FROM grouped GROUP BY dataset, chrom, bc, island""",
}
