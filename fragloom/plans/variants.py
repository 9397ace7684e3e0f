"""Queries on windows, breakpoints and their support, over fragments and called events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom.functions.conventions import measurement
from fragloom.operators import readclouds as rc
from fragloom.operators import support as su
from fragloom.operators import tracks as tr
from fragloom.operators import windows as wi
from fragloom.plans.problems import FRAGMENTS_SQL
from fragloom.plans.tables import fragments, genotypes, table
from fragloom.session import Scratch

#: The test tables are thin: fewer shared barcodes and weaker tests than the operators' defaults.
MIN_SHARED, MAX_P, NEAR, FAR, PAD = 3, 1e-4, -500, 5_000, 20_000


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments(spark, sf_dir, "dataset", "chrom", "start_pos", "end_pos", "bc", "num_reads", "hap")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called events with both sides."""
    return genotypes(spark, sf_dir).where("y IS NOT NULL AND chromy IS NOT NULL").withColumnRenamed("geno_id", "event_id").select("event_id", "dataset", "chromx", "x", "chromy", "y", "orientation")


def window_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.window_barcodes(_fragments(spark, sf_dir), table(spark, sf_dir, "chroms"))


def _overlaps(spark: SparkSession, sf_dir: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    windows = scratch.table(window_barcodes(spark, sf_dir))
    return windows, wi.window_overlaps(windows, table(spark, sf_dir, "chroms"), scratch, min_shared=MIN_SHARED)


def window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir, Scratch(spark, "windows"))[1]


def _tested(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    windows, overlaps = _overlaps(spark, sf_dir, scratch)
    return wi.overlap_p(overlaps, windows)


def window_overlap_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tested(spark, sf_dir, Scratch(spark, "windows"))
    return p.select("dataset", "chromx", "wx", "chromy", "wy", "shared", F.when(F.col("p") > 0, F.round(F.log10("p"), 4)).alias("log_p"))


def sv_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "regions")
    tested = scratch.table(_tested(spark, sf_dir, scratch))
    out = wi.sv_regions(tested, wi.significant(tested, MIN_SHARED, MAX_P), scratch)
    return out.select("dataset", "chromx", "chromy", "startx", "endx", "starty", "endy", F.when(F.col("p") > 0, F.round(F.log10("p"), 4)).alias("log_p"), F.col("count").alias("n_pairs"))


def region_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows with the least p in every region."""
    scratch = Scratch(spark, "regions")
    tested = scratch.table(_tested(spark, sf_dir, scratch))
    return wi.sv_regions(tested, wi.significant(tested, MIN_SHARED, MAX_P), scratch).select("dataset", "chromx", "chromy", "startx", "starty", "best_x", "best_y")


def region_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir, "obs_len").select(measurement(F.col("obs_len")).alias("len"))
    return wi.region_distance(f)


def fragment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of more than one read over the first 20 Mb of every chromosome's file, read back from files by chromosome."""
    path = f"{Scratch(spark, 'fragments').root}/by-chromosome"
    f = _fragments(spark, sf_dir).where("end_pos > start_pos").select("frag_id", "chrom", "start_pos", "end_pos", "bc", "num_reads")
    rc.write_fragments(f, path)
    parts = [rc.read_fragments(spark, path, r.chrom, 0, 20_000_000) for r in table(spark, sf_dir, "chroms").select("chrom").collect()]
    return reduce(DataFrame.unionByName, parts).select("frag_id", "chrom", "start_pos", "end_pos")


def fragment_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fragments a sample of 500 from each dataset holds, and how many different ones."""
    f = rc.sampled(_fragments(spark, sf_dir), 500, ["dataset"], "frag_id")
    return f.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("frag_id").alias("n_different"))


def event_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_characteristics`` and whether the lengths of the molecules across the event are those of its datasets."""
    from fragloom.plans.genotyping import length_filter

    out = pair_characteristics(spark, sf_dir).join(length_filter(spark, sf_dir), "event_id", "left")
    return out.select("event_id", "supporting", "overlapping", "fraction", F.coalesce("frag_length_passes", F.lit(False)).alias("lengths_match"))


def genome_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that start in each near-equal chunk of the genome of at most 50 Mb."""
    chroms = table(spark, sf_dir, "chroms")
    chunks, steps = wi.split_genome(chroms, 50_000_000), wi.chunk_steps(chroms, 50_000_000)
    f = _fragments(spark, sf_dir).select("chrom", "start_pos").join(steps, "chrom").where("start_pos BETWEEN 0 AND length - 1")
    counts = f.groupBy("chrom", F.expr("start_pos - start_pos % step").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return chunks.join(counts, ["chrom", "start"], "left").select("chrom", "start", "end", F.coalesce("n", F.lit(0)).alias("n"))


def breakend_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments and barcodes near each side of each event, by dataset."""
    near = su.near_breakends(su.breakends(events(spark, sf_dir)), _fragments(spark, sf_dir), ["event_id", "side"], NEAR, FAR)
    return near.groupBy("event_id", "side", "dataset").agg(F.count_distinct("frag_id").alias("n_fragments"), F.count_distinct("bc").alias("n_barcodes"))


def quantify(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = su.quantify(events(spark, sf_dir), _fragments(spark, sf_dir), NEAR, FAR)
    return q.withColumn("log_p", F.when(F.col("p_fisher") > 0, F.round(F.log10("p_fisher"), 4))).drop("p_fisher")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' support over the datasets that pass."""
    r = su.roll_up_samples(su.quantify(events(spark, sf_dir), _fragments(spark, sf_dir), NEAR, FAR))
    return r.select("event_id", "shared", "total", F.when(F.col("p") > 0, F.round(F.log10("p"), 4)).alias("log_p"))


def fragment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fragments of one barcode around both sides of the events of their dataset."""
    e = events(spark, sf_dir)
    around = [(F.col(s) + d).alias(n + s) for s in "xy" for n, d in (("start", -PAD), ("end", PAD))]
    regions = e.select(F.col("event_id").alias("region_id"), "dataset", "chromx", "chromy", *around)
    return su.fragment_pairs(regions, _fragments(spark, sf_dir)).select("region_id", "bc", "frag_x", "frag_y")


def fragment_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments around both sides of every event, of the barcodes that support both."""
    return tr.fragment_tracks(tr.event_sites(events(spark, sf_dir)), _fragments(spark, sf_dir))


def pair_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs of fragments around an event those at both breakends, as a share of those over both."""
    e = events(spark, sf_dir)
    around = [(F.col(s) + d).alias(n + s) for s in "xy" for n, d in (("start", -PAD), ("end", PAD))]
    pairs = su.fragment_pairs(e.select("event_id", "dataset", "chromx", "chromy", *around), _fragments(spark, sf_dir), ["event_id"])
    return tr.pair_characteristics(e, pairs, NEAR, FAR)


def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakends of the events with many barcodes in common."""
    f = _fragments(spark, sf_dir)
    near = su.near_breakends(su.breakends(events(spark, sf_dir)), f, ["event_id", "side"], -1_000, 5_000)
    n = f.where("bc IS NOT NULL").groupBy("dataset").agg(F.count_distinct("bc").alias("n_bcs"))
    out = su.pair_evidence(near.select("dataset", "chrom", "pos", "orientation", "bc"), n, min_shared=5)
    return out.withColumn("log_p", F.when(F.col("p") > 0, F.round(F.log10("p"), 4))).drop("p")


QUERIES = {q.__name__: q for q in (region_best, region_distance, fragment_scan, fragment_sample, event_characteristics, genome_chunks, window_barcodes, window_overlaps, window_overlap_p, sv_regions, breakend_support, quantify, event_samples, fragment_pairs, fragment_tracks, pair_characteristics, pair_evidence)}

_WINDOWS = f"""WITH RECURSIVE {FRAGMENTS_SQL},
wins AS (SELECT chrom, w, w * 10000 AS a, (w + 1) * 10000 AS b FROM (SELECT chrom, unnest(range(0, CAST(ceil(length / 10000) AS BIGINT))) AS w FROM chroms)),
usable AS (SELECT dataset, chrom, bc, start_pos AS s, end_pos AS e FROM frags WHERE bc IS NOT NULL AND end_pos > start_pos),
wb AS (SELECT dataset, u.chrom, w, bc FROM usable u JOIN wins ON wins.chrom = u.chrom AND s < a AND e > a UNION SELECT dataset, u.chrom, w, bc FROM usable u JOIN wins ON wins.chrom = u.chrom AND s < b AND e > b)"""
_OVERLAPS = f"""{_WINDOWS}, sized AS (SELECT dataset, chrom, w, count(*) AS n FROM wb GROUP BY ALL), big AS (SELECT wb.*, n, idx FROM wb JOIN sized USING (dataset, chrom, w) JOIN chroms USING (chrom) WHERE n >= {MIN_SHARED}),
ov AS (SELECT x.dataset, x.chrom AS chromx, x.w AS wx, y.chrom AS chromy, y.w AS wy, count(*) AS shared, any_value(x.n) AS nx, any_value(y.n) AS ny FROM big x JOIN big y ON x.dataset = y.dataset AND x.bc = y.bc
  AND (x.idx > y.idx OR x.idx = y.idx AND x.w < y.w) GROUP BY ALL HAVING count(*) >= {MIN_SHARED}),
n_bcs AS (SELECT dataset, count(DISTINCT bc) AS n_bcs FROM wb GROUP BY dataset),
terms AS (SELECT o.*, ny / n_bcs AS q, unnest(range(shared + 1, nx + 1)) AS i FROM ov o JOIN n_bcs USING (dataset)),
tail AS (SELECT dataset, chromx, wx, chromy, wy, sum(exp(lgamma(nx + 1) - lgamma(i + 1) - lgamma(nx - i + 1) + i * ln(q) + (nx - i) * ln(1 - q))) AS p FROM terms GROUP BY ALL),
tested AS (SELECT o.*, CASE WHEN coalesce(p, 0) > 0.001 THEN 1.0 ELSE coalesce(p, 0) END AS p FROM ov o LEFT JOIN tail USING (dataset, chromx, wx, chromy, wy))"""
_LOG = "CASE WHEN p > 0 THEN round(log10(p), 4) END AS log_p"
_SUPPORT = f"""WITH {FRAGMENTS_SQL},
sides AS (SELECT geno_id AS event_id, 'x' AS side, coalesce(name, chromx) AS chrom, x AS pos, substr(orientation, 1, 1) AS o FROM genotypes LEFT JOIN names ON spelling = chromx WHERE y IS NOT NULL AND chromy IS NOT NULL
  UNION ALL SELECT geno_id, 'y', coalesce(name, chromy), y, substr(orientation, 2, 1) FROM genotypes LEFT JOIN names ON spelling = chromy WHERE y IS NOT NULL AND chromy IS NOT NULL),
usable AS (SELECT * FROM frags WHERE bc IS NOT NULL AND end_pos > start_pos),
near AS (SELECT event_id, side, s.chrom, pos, o, dataset, frag_id, bc, hap FROM sides s JOIN usable f ON f.chrom = s.chrom AND o = '+' AND end_pos > pos - {{far}} AND end_pos <= pos - {{near}} AND end_pos >= 0
  UNION ALL SELECT event_id, side, s.chrom, pos, o, dataset, frag_id, bc, hap FROM sides s JOIN usable f ON f.chrom = s.chrom AND o = '-' AND start_pos >= pos + {{near}} AND start_pos <= pos + {{far}} AND start_pos >= 0)"""
_NEAR = _SUPPORT.format(near=NEAR, far=FAR)
_QUANTIFY = f"""{_NEAR}, bx AS (SELECT event_id, dataset, bc, count(DISTINCT frag_id) AS n, min(frag_id) AS f FROM near WHERE side = 'x' GROUP BY ALL), by_ AS (SELECT event_id, dataset, bc, count(DISTINCT frag_id) AS n, min(frag_id) AS f FROM near WHERE side = 'y' GROUP BY ALL),
bcs AS (SELECT event_id, dataset, bc, bx.n AS nx, by_.n AS ny FROM bx FULL JOIN by_ USING (event_id, dataset, bc) WHERE NOT coalesce(bx.n = 1 AND by_.n = 1 AND bx.f = by_.f, false)),
counts AS (SELECT event_id, dataset, count(*) FILTER (nx IS NOT NULL AND ny IS NOT NULL) AS shared, count(*) AS total, count(*) FILTER (ny IS NULL) AS only_x, count(*) FILTER (nx IS NULL) AS only_y FROM bcs GROUP BY ALL),
fx AS (SELECT DISTINCT event_id, dataset, bc, frag_id, hap FROM near WHERE side = 'x'), fy AS (SELECT DISTINCT event_id, dataset, bc, frag_id, hap FROM near WHERE side = 'y'),
merged AS (SELECT event_id, dataset, fx.hap AS hx, fy.hap AS hy FROM fx JOIN fy USING (event_id, dataset, bc) WHERE fx.frag_id <> fy.frag_id),
haps AS (SELECT event_id, dataset, count(*) FILTER (hx IN (0, 2)) AS x_hap0, count(*) FILTER (hx = 1) AS x_hap1, count(*) FILTER (hy IN (0, 2)) AS y_hap0, count(*) FILTER (hy = 1) AS y_hap1 FROM merged GROUP BY ALL),
good AS (SELECT dataset, count(DISTINCT bc) AS good FROM frags WHERE bc IS NOT NULL GROUP BY dataset),
cells AS (SELECT event_id, dataset, shared, total, only_x, only_y, good - total AS rest, unnest(range(shared, least(shared + only_x, shared + only_y) + 1)) AS i FROM counts JOIN good USING (dataset)),
fisher AS (SELECT event_id, dataset, sum(exp(lgamma(shared + only_y + 1) - lgamma(i + 1) - lgamma(shared + only_y - i + 1) + lgamma(only_x + rest + 1) - lgamma(shared + only_x - i + 1) - lgamma(only_x + rest - shared - only_x + i + 1)
  - lgamma(total + rest + 1) + lgamma(shared + only_x + 1) + lgamma(total + rest - shared - only_x + 1))) AS p FROM cells GROUP BY ALL),
quantified AS (SELECT event_id, dataset, shared, total, only_x, only_y, coalesce(x_hap0, 0) AS x_hap0, coalesce(x_hap1, 0) AS x_hap1, coalesce(y_hap0, 0) AS y_hap0, coalesce(y_hap1, 0) AS y_hap1, least(p, 1.0) AS p FROM counts LEFT JOIN haps USING (event_id, dataset) JOIN fisher USING (event_id, dataset))"""
SQL = {
    "genome_chunks": f"""WITH {FRAGMENTS_SQL}, steps AS (SELECT chrom, length, CAST(ceil(length / ceil(length / 50000000)) AS BIGINT) AS step FROM chroms),
chunks AS (SELECT chrom, "start", least("start" + step, length) AS "end" FROM (SELECT chrom, length, step, unnest(range(0, length, step)) AS "start" FROM steps))
SELECT c.chrom, c."start", c."end", count(f.start_pos) AS n FROM chunks c LEFT JOIN frags f ON f.chrom = c.chrom AND f.start_pos >= c."start" AND f.start_pos < c."end" GROUP BY ALL""",
    "window_barcodes": f"{_WINDOWS} SELECT * FROM wb",
    "window_overlaps": f"{_OVERLAPS} SELECT * FROM ov",
    "window_overlap_p": f"{_OVERLAPS} SELECT dataset, chromx, wx, chromy, wy, shared, {_LOG} FROM tested",
    "sv_regions": f"""{_OVERLAPS}, sig AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY dataset, chromx, chromy, wx, wy) AS c FROM tested WHERE shared > {MIN_SHARED} AND p < {MAX_P} AND abs(wx - wy) > 10),
touch AS MATERIALIZED (SELECT a.c AS u, b.c AS v FROM sig a JOIN sig b ON a.dataset = b.dataset AND a.chromx = b.chromx AND a.chromy = b.chromy AND abs(a.wx - b.wx) <= 1 AND abs(a.wy - b.wy) <= 1),
reach(c, other) AS (SELECT c, c FROM sig UNION SELECT r.c, t.v FROM reach r JOIN touch t ON t.u = r.other), comp AS (SELECT c, min(other) AS g FROM reach GROUP BY c),
boxes AS (SELECT dataset, chromx, chromy, g, min(wx) AS ax, max(wx) AS bx, min(wy) AS ay, max(wy) AS by_, count(*) AS n_pairs FROM sig JOIN comp USING (c) GROUP BY ALL),
best AS (SELECT g, min(p) AS p FROM boxes b JOIN tested t ON t.dataset = b.dataset AND t.chromx = b.chromx AND t.chromy = b.chromy AND wx BETWEEN ax AND bx AND wy BETWEEN ay AND by_ GROUP BY g)
SELECT dataset, chromx, chromy, ax * 10000 AS startx, (bx + 1) * 10000 AS endx, ay * 10000 AS starty, (by_ + 1) * 10000 AS endy, {_LOG}, n_pairs FROM boxes JOIN best USING (g)""",
    "region_distance": f"WITH {FRAGMENTS_SQL} SELECT quantile_cont(obs_len, 0.8) AS distance FROM (SELECT DISTINCT frag_id, obs_len FROM frags) WHERE obs_len >= 0 AND obs_len < 500000000",
    "fragment_scan": f"WITH {FRAGMENTS_SQL} SELECT DISTINCT frag_id, chrom, start_pos, end_pos FROM frags WHERE end_pos > start_pos AND num_reads > 1 AND start_pos < 20000000 AND end_pos > 0 AND chrom IN (SELECT chrom FROM chroms)",
    "fragment_sample": f"WITH {FRAGMENTS_SQL} SELECT dataset, least(count(*), 500) AS n, least(count(DISTINCT frag_id), 500) AS n_different FROM frags GROUP BY dataset",
    "breakend_support": f"{_NEAR} SELECT event_id, side, dataset, count(DISTINCT frag_id) AS n_fragments, count(DISTINCT bc) AS n_barcodes FROM near GROUP BY ALL",
    "quantify": f"{_QUANTIFY} SELECT * EXCLUDE (p), {_LOG} FROM quantified",
    "event_samples": f"""{_QUANTIFY}, rolled AS (SELECT event_id, CAST(coalesce(sum(shared) FILTER (p < 1e-4 AND shared > total * 0.1), 0) AS BIGINT) AS shared, CAST(coalesce(sum(total) FILTER (p < 1e-4 AND shared > total * 0.1), 0) AS BIGINT) AS total, min(p) AS p FROM quantified GROUP BY event_id)
SELECT event_id, shared, total, {_LOG} FROM rolled""",
    "fragment_pairs": f"""WITH {FRAGMENTS_SQL}, e AS (SELECT geno_id, dataset, coalesce(nx.name, chromx) AS cx, x, coalesce(ny.name, chromy) AS cy, y FROM genotypes LEFT JOIN names nx ON nx.spelling = chromx LEFT JOIN names ny ON ny.spelling = chromy WHERE y IS NOT NULL AND chromy IS NOT NULL),
u AS (SELECT * FROM frags WHERE bc IS NOT NULL AND start_pos <= end_pos),
fx AS (SELECT geno_id, e.dataset, bc, frag_id FROM e JOIN u ON u.dataset = e.dataset AND u.chrom = cx AND end_pos >= x - {PAD} AND start_pos <= x + {PAD}), fy AS (SELECT geno_id, e.dataset, bc, frag_id FROM e JOIN u ON u.dataset = e.dataset AND u.chrom = cy AND end_pos >= y - {PAD} AND start_pos <= y + {PAD})
SELECT geno_id AS region_id, bc, fx.frag_id AS frag_x, fy.frag_id AS frag_y FROM fx JOIN fy USING (geno_id, bc) WHERE fx.frag_id <> fy.frag_id""",
    "fragment_tracks": f"""WITH {FRAGMENTS_SQL}, e AS (SELECT geno_id, dataset, coalesce(nx.name, chromx) AS cx, x, coalesce(ny.name, chromy) AS cy, y, orientation FROM genotypes LEFT JOIN names nx ON nx.spelling = chromx LEFT JOIN names ny ON ny.spelling = chromy WHERE y IS NOT NULL AND chromy IS NOT NULL),
sites AS (SELECT geno_id, dataset, 0 AS site, cx AS chrom, x AS pos, substr(orientation, 1, 1) AS o FROM e UNION ALL SELECT geno_id, dataset, 1, cy, y, substr(orientation, 2, 1) FROM e),
found AS (SELECT geno_id, site, frag_id, bc, start_pos, end_pos, CASE o WHEN '+' THEN pos - end_pos BETWEEN -500 AND 5000 WHEN '-' THEN start_pos - pos BETWEEN -500 AND 5000 ELSE start_pos > pos - 500 AND end_pos < pos + 500 END AS supporting
  FROM sites s JOIN frags f ON f.dataset = s.dataset AND f.chrom = s.chrom AND bc IS NOT NULL AND end_pos > start_pos AND start_pos < pos + 100000 AND end_pos > greatest(pos - 100000, 1)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY geno_id, bc ORDER BY site, start_pos, end_pos) AS k FROM found WHERE supporting),
good AS (SELECT geno_id, bc FROM firsts GROUP BY ALL HAVING count(DISTINCT site) > 1),
numbered AS (SELECT geno_id, bc, row_number() OVER (PARTITION BY geno_id ORDER BY site, start_pos, end_pos, bc) - 1 AS track FROM firsts JOIN good USING (geno_id, bc) WHERE k = 1)
SELECT geno_id AS event_id, site, frag_id, bc, start_pos, end_pos, supporting, track FROM found JOIN numbered USING (geno_id, bc)""",
    "pair_characteristics": f"""WITH {FRAGMENTS_SQL}, e AS (SELECT geno_id, dataset, coalesce(nx.name, chromx) AS cx, x, coalesce(ny.name, chromy) AS cy, y, orientation FROM genotypes LEFT JOIN names nx ON nx.spelling = chromx LEFT JOIN names ny ON ny.spelling = chromy WHERE y IS NOT NULL AND chromy IS NOT NULL),
u AS (SELECT * FROM frags WHERE bc IS NOT NULL AND start_pos <= end_pos),
fx AS (SELECT geno_id, bc, frag_id, start_pos AS s, end_pos AS t FROM e JOIN u ON u.dataset = e.dataset AND u.chrom = cx AND end_pos >= x - {PAD} AND start_pos <= x + {PAD}), fy AS (SELECT geno_id, bc, frag_id, start_pos AS s, end_pos AS t FROM e JOIN u ON u.dataset = e.dataset AND u.chrom = cy AND end_pos >= y - {PAD} AND start_pos <= y + {PAD}),
pairs AS (SELECT geno_id, fx.s AS sx, fx.t AS tx, fy.s AS sy, fy.t AS ty FROM fx JOIN fy USING (geno_id, bc) WHERE fx.frag_id <> fy.frag_id),
counts AS (SELECT geno_id, count(*) FILTER (CASE orientation[1] WHEN '+' THEN x - tx WHEN '-' THEN sx - x END BETWEEN {NEAR} AND {FAR} AND CASE orientation[2] WHEN '+' THEN y - ty WHEN '-' THEN sy - y END BETWEEN {NEAR} AND {FAR}) AS supporting,
  count(*) FILTER (sx <= x + 12000 AND tx >= x - 12000 AND sy <= y + 12000 AND ty >= y - 12000) AS overlapping FROM e LEFT JOIN pairs USING (geno_id) GROUP BY ALL)
SELECT geno_id AS event_id, supporting, overlapping, CASE WHEN overlapping > 0 THEN supporting / overlapping ELSE 0 END AS fraction FROM counts""",
    "pair_evidence": f"""{_SUPPORT.format(near=-1000, far=5000)}, ends AS (SELECT DISTINCT dataset, chrom, pos, o, bc FROM near), n AS (SELECT dataset, chrom, pos, o, count(*) AS n FROM ends GROUP BY ALL), sized AS (SELECT * FROM ends JOIN n USING (dataset, chrom, pos, o) WHERE n >= 5),
pairs AS (SELECT a.dataset, a.chrom AS chromx, a.pos AS x, a.o AS ox, b.chrom AS chromy, b.pos AS y, b.o AS oy, count(*) AS shared, any_value(a.n) AS nx, any_value(b.n) AS ny FROM sized a JOIN sized b ON a.dataset = b.dataset AND a.bc = b.bc
  AND (a.chrom < b.chrom OR a.chrom = b.chrom AND (a.pos < b.pos OR a.pos = b.pos AND a.o < b.o)) GROUP BY ALL HAVING count(*) >= 5),
kinds AS (SELECT *, nx + ny - shared AS total, CASE WHEN chromx = chromy AND abs(x - y) < 100000 AND CASE WHEN x <= y THEN ox ELSE oy END = '-' AND CASE WHEN x <= y THEN oy ELSE ox END = '+' THEN CASE WHEN abs(x - y) < 1000 THEN 'bad' ELSE 'facing' END ELSE 'breakpoint' END AS facing FROM pairs),
kept AS (SELECT * FROM kinds WHERE facing <> 'bad' AND shared > total * 0.01), n_bcs AS (SELECT dataset, count(DISTINCT bc) AS n_bcs FROM frags WHERE bc IS NOT NULL GROUP BY dataset),
terms AS (SELECT k.*, ny / n_bcs AS q, unnest(range(shared + 1, total + 1)) AS i FROM kept k JOIN n_bcs USING (dataset)),
tail AS (SELECT dataset, chromx, x, ox, chromy, y, oy, sum(exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * ln(q) + (total - i) * ln(1 - q))) AS p FROM terms GROUP BY ALL)
SELECT k.dataset, k.chromx, k.x, k.ox, k.chromy, k.y, k.oy, shared, total, facing, {_LOG} FROM kept k LEFT JOIN tail USING (dataset, chromx, x, ox, chromy, y, oy)""",
}

_BOXES = SQL["sv_regions"].split("best AS (")[0]
SQL["region_best"] = f"""{_BOXES}cells AS (SELECT b.*, wx, wy, row_number() OVER (PARTITION BY g ORDER BY p, wy, wx) AS k FROM boxes b JOIN tested t ON t.dataset = b.dataset AND t.chromx = b.chromx AND t.chromy = b.chromy AND wx BETWEEN ax AND bx AND wy BETWEEN ay AND by_)
SELECT dataset, chromx, chromy, ax * 10000 AS startx, ay * 10000 AS starty, wx * 10000 AS best_x, wy * 10000 AS best_y FROM cells WHERE k = 1"""
