"""Queries of problems 2, 3 and 5 over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom.functions.conventions import barcode, measurement, with_chromosome
from fragloom.llm.components import group_rows
from fragloom.llm.overlaps import PairCounts, buckets_for
from fragloom.llm.percentiles import PERCENTS, merge_sketches, percentile_sketches, percentiles
from fragloom.plans.problems import FRAGMENTS_SQL
from fragloom.plans.tables import fragments, genotypes, table
from fragloom.session import Scratch

MIN_SET, SHARE = 40, (3, 20)  # a pair has much in common from 3 / 20 on
RECENT = 21  # days


def _breakend(chrom: str, pos: str, side: int) -> Column:
    return F.when(F.col(chrom).isNotNull() & F.col(pos).isNotNull(), F.concat_ws("|", F.lit("b"), chrom, pos, F.substring("orientation", side, 1)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = F.when(F.col("cluster") != -1, F.concat(F.lit("c|"), "cluster"))
    keys = [cluster, _breakend("chromx", "x", 1), _breakend("chromy", "y", 2)]
    return group_rows(genotypes(spark, sf_dir), "geno_id", keys, Scratch(spark, "p2"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group with its number of rows; groups of one included."""
    return p2_found(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("geno_id").alias("last_geno_id"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir, "dataset", "chrom", "run_day", "obs_len").withColumn("obs_len", measurement(F.col("obs_len")))
    return percentile_sketches(f, ["dataset", "chrom", "run_day"], "obs_len", Scratch(spark, "p3"))


def p3_fragment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the observed length by dataset, chromosome and day."""
    return percentiles(_daily(spark, sf_dir))


def p3_dataset_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by dataset, from the sketches of its days and chromosomes."""
    return percentiles(merge_sketches(_daily(spark, sf_dir), ["dataset"]))


def p3_dataset_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each percentile of a dataset is a value whose rank is no further off than it says, held against all values."""
    found = p3_dataset_lengths(spark, sf_dir)
    f = fragments(spark, sf_dir, "dataset", "obs_len").select("dataset", measurement(F.col("obs_len")).alias("len")).where("len IS NOT NULL")
    names = [f"p{p:02d}" for p in PERCENTS]
    counts = [c for n in names for c in (F.count_if(F.col("len") < F.col(n)).alias(f"below_{n}"), F.count_if(F.col("len") <= F.col(n)).alias(f"upto_{n}"))]
    held = f.join(found, "dataset").groupBy("dataset", "n", "max_rank_error").agg(*counts)
    off = lambda p, n: F.greatest(F.col(f"below_{n}") + 1 - rank(p), rank(p) - F.col(f"upto_{n}"), F.lit(0))
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.col("n") * p / 100))
    return held.select("dataset", "n", *[(off(p, n) <= F.col("max_rank_error")).alias(n) for p, n in zip(PERCENTS, names)])


def p3_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the cluster size by dataset and kind."""
    g = table(spark, sf_dir, "genotypes").select("dataset", F.lower(F.trim("kind")).alias("kind"), measurement(F.col("cluster_size")).alias("cluster_size"))
    return percentiles(percentile_sketches(g, ["dataset", "kind"], "cluster_size", Scratch(spark, "p3")))


def _pair_counts(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """Overlaps of the barcode sets, built up in batches by the time at which a barcode first came in for its set."""
    scratch = Scratch(spark, "p5")
    f = table(spark, sf_dir, "fragments").select("dataset", "chrom", barcode(F.col("bc")).alias("id"), F.unix_micros(F.col("delivered_at").cast("timestamp")).alias("seq"))
    f = with_chromosome(f.where("id IS NOT NULL"), table(spark, sf_dir, "chroms"), "chrom")
    # what has no time comes first
    first = F.coalesce(F.min("seq"), F.lit(-(1 << 63)).cast("bigint"))
    joins = scratch.table(f.groupBy(F.concat_ws("|", "dataset", "chrom").alias("set_name"), "id").agg(first.alias("seq")))
    cuts = joins.agg(F.percentile_approx("seq", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    counts = PairCounts(scratch, buckets=buckets_for(joins.count()))
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = joins.where((F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else F.col("seq") <= high))
        counts.apply(batch.withColumn("present", F.lit(True)))
    out = counts.overlaps()
    counts.close()
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = (F.col("size_a") >= MIN_SET) & (F.col("size_b") >= MIN_SET)
    return _pair_counts(spark, sf_dir).where(big & (F.col("shared") * SHARE[1] >= F.col("total") * SHARE[0])).select("set_a", "set_b")


def p5_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared and total barcodes of every pair of sets that have one in common."""
    return _pair_counts(spark, sf_dir)


def p5_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the barcodes of the last days alone: as time goes on barcodes join, and those not seen again leave.

    The sets are brought up to date at the end of each of three stretches of ``RECENT`` days, and between two of them the state
    is closed and opened again from its folder.
    """
    scratch = Scratch(spark, "p5")
    f = table(spark, sf_dir, "fragments").where("run_day IS NOT NULL").select("dataset", "chrom", barcode(F.col("bc")).alias("id"), F.unix_date(F.col("run_day").cast("date")).alias("day"))
    f = with_chromosome(f.where("id IS NOT NULL"), table(spark, sf_dir, "chroms"), "chrom")
    seen = f.groupBy(F.concat_ws("|", "dataset", "chrom").alias("set_name"), "id", "day").agg(F.count(F.lit(1)).alias("n"))
    last = table(spark, sf_dir, "fragments").agg(F.max(F.unix_date(F.col("run_day").cast("date")))).first()[0] or 0
    stretch = F.expr(f"({last} - day) div {RECENT}")
    seen = scratch.table(seen.withColumn("back", stretch).where("back < 3").select("set_name", "id", "back").distinct())
    counts = PairCounts(scratch, buckets=buckets_for(seen.count()))
    for back in (2, 1, 0):
        joins = seen.where(F.col("back") == back).select("set_name", "id", F.lit(True).alias("present"), F.lit(1).alias("seq"))
        leaves = counts.members.select("set_name", "id", F.lit(False).alias("present"), F.lit(0).alias("seq"))
        counts.apply(joins.unionByName(leaves))
        counts.close()
        counts = PairCounts(scratch, counts.root)
    out = counts.overlaps()
    counts.close()
    return out


QUERIES = {q.__name__: q for q in (p2_found, p2_groups, p3_fragment_lengths, p3_dataset_lengths, p3_dataset_ranks, p3_cluster_sizes, p5_found, p5_overlaps, p5_recent)}

_GROUPS = """WITH RECURSIVE names AS (SELECT spelling, min_by(chrom, idx) AS name FROM (SELECT chrom, idx, unnest([chrom, alias_name, accession]) AS spelling FROM chroms) GROUP BY spelling),
sides AS (SELECT geno_id, chromx AS c, x AS p, substr(orientation, 1, 1) AS o FROM genotypes UNION ALL SELECT geno_id, chromy, y, substr(orientation, 2, 1) FROM genotypes),
keys AS (SELECT geno_id, 'c' || cluster AS k FROM genotypes WHERE cluster <> -1
         UNION SELECT geno_id, 'b|' || coalesce(name, c) || '|' || p || '|' || o FROM sides LEFT JOIN names ON spelling = c WHERE c IS NOT NULL AND p IS NOT NULL),
links AS MATERIALIZED (SELECT DISTINCT a.geno_id AS u, b.geno_id AS v FROM keys a JOIN (SELECT k, min(geno_id) AS geno_id FROM keys GROUP BY k) b USING (k)),
both_ways AS MATERIALIZED (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(geno_id, other) AS (SELECT geno_id, geno_id FROM genotypes UNION SELECT r.geno_id, l.v FROM reach r JOIN both_ways l ON l.u = r.other),
found AS (SELECT geno_id, min(other) AS group_id FROM reach GROUP BY geno_id)
"""
_MEMBERS = f"WITH {FRAGMENTS_SQL}, m AS (SELECT DISTINCT dataset || '|' || chrom AS s, bc FROM frags WHERE bc IS NOT NULL)"
_LATE = f"WITH {FRAGMENTS_SQL}, m AS (SELECT DISTINCT dataset || '|' || chrom AS s, bc FROM frags WHERE bc IS NOT NULL AND date_diff('day', run_day, (SELECT max(run_day) FROM fragments)) < {RECENT})"
_COUNTED = """, n AS (SELECT s, count(*) AS n FROM m GROUP BY s),
shared AS (SELECT a.s AS set_a, b.s AS set_b, count(*) AS shared FROM m a JOIN m b ON a.bc = b.bc AND a.s < b.s GROUP BY a.s, b.s),
pairs AS (SELECT set_a, set_b, a.n AS size_a, b.n AS size_b, shared, a.n + b.n - shared AS total FROM shared JOIN n a ON a.s = set_a JOIN n b ON b.s = set_b)
"""
_RANKED = "SELECT *, count(*) OVER (PARTITION BY {by}) AS n, row_number() OVER (PARTITION BY {by} ORDER BY v) AS k FROM vals"
_PERCENTILES = ", ".join(f"max(CAST(v AS DOUBLE)) FILTER (k = greatest(1, CAST(ceil(n * {p} / 100.0) AS BIGINT))) AS p{p:02d}" for p in PERCENTS)
#: True ranks: groups of up to 1,024 values, as all of these are in small tables, come out exactly.
_EXACT = f"{{vals}}, ranked AS ({_RANKED}) SELECT {{by}}, n, {_PERCENTILES}, 0 AS max_rank_error FROM ranked GROUP BY {{by}}, n"
SQL = {
    "p3_fragment_lengths": _EXACT.format(by="dataset, chrom, run_day", vals=f"WITH {FRAGMENTS_SQL}, vals AS (SELECT dataset, chrom, run_day, obs_len AS v FROM frags WHERE obs_len >= 0 AND obs_len < 500000000)"),
    "p3_cluster_sizes": _EXACT.format(by="dataset, kind", vals="WITH vals AS (SELECT dataset, lower(trim(kind)) AS kind, cluster_size AS v FROM genotypes WHERE cluster_size >= 0 AND cluster_size < 500000000)"),
    "p3_dataset_ranks": f"WITH {FRAGMENTS_SQL} SELECT dataset, count(*) AS n, {', '.join(f'true AS p{p:02d}' for p in PERCENTS)} FROM frags WHERE obs_len >= 0 AND obs_len < 500000000 GROUP BY dataset",
    "p2_found": f"{_GROUPS} SELECT geno_id, group_id FROM found",
    "p2_groups": f"{_GROUPS} SELECT group_id, count(*) AS n_rows, max(geno_id) AS last_geno_id FROM found GROUP BY group_id",
    "p5_found": f"{_MEMBERS}{_COUNTED} SELECT set_a, set_b FROM pairs WHERE size_a >= {MIN_SET} AND size_b >= {MIN_SET} AND shared * {SHARE[1]} >= total * {SHARE[0]}",
    "p5_overlaps": f"{_MEMBERS}{_COUNTED} SELECT * FROM pairs",
    "p5_recent": f"{_LATE}{_COUNTED} SELECT * FROM pairs",
}
