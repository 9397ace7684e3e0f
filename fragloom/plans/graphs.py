"""Queries on candidates and event graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom.operators import candidates as ca
from fragloom.operators import evidence as ev
from fragloom.operators import graph as gr
from fragloom.operators import support as su
from fragloom.plans import variants as va
from fragloom.plans.tables import fragments, genotypes, table, tips
from fragloom.session import Scratch

BIN, WIDE = 2_000, 100_000
#: The test tables' events have fewer barcodes than the operator's defaults.
EDGE = {"max_p": 1e-4, "min_total": 20, "min_ratio": 0.01, "min_shared": 5}


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes(spark, sf_dir).withColumnRenamed("geno_id", "event_id").select("event_id", "chromx", "x", "chromy", "y", "orientation", "shared", "total", "p", F.lower("kind").alias("kind"), "assembled")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = [(F.col(s) + d).alias(n + s) for s in "xy" for n, d in (("start", -va.PAD), ("end", va.PAD))]
    return va.events(spark, sf_dir).select(F.col("event_id").alias("region_id"), "dataset", "chromx", "chromy", *around)


def _pairs(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    f = fragments(spark, sf_dir, "dataset", "chrom", "start_pos", "end_pos", "bc")
    return scratch.table(su.fragment_pairs(_regions(spark, sf_dir), f))


def end_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.end_histogram(_pairs(spark, sf_dir, Scratch(spark, "pairs")), _regions(spark, sf_dir), size=BIN)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, regions = _pairs(spark, sf_dir, Scratch(spark, "pairs")), _regions(spark, sf_dir)
    return ca.background_union(pairs, regions, ca.end_histogram(pairs, regions, size=BIN), size=BIN)


def background_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.overlap_matrix(_pairs(spark, sf_dir, Scratch(spark, "pairs")), _regions(spark, sf_dir), size=BIN)


def marginal_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the overlap matrix of every region falls off along both sides."""
    regions = _regions(spark, sf_dir)
    return ca.marginal_breakpoints(ca.overlap_matrix(_pairs(spark, sf_dir, Scratch(spark, "pairs")), regions, size=BIN), regions, size=BIN)


def reference_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called events on chromosomes of the reference."""
    return gr.on_reference(_called(spark, sf_dir).select("event_id", "chromx", "chromy"), table(spark, sf_dir, "chroms"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.peaks(_cells(spark, sf_dir), min_count=2)


def refined_breakends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakends moved to where the coverage of the fragments near them drops."""
    return tips(spark, sf_dir).refined(su.breakends(va.events(spark, sf_dir)), 20_000)


def combined_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = va.events(spark, sf_dir)
    return ca.combine_events(events, ca.cluster_points(events, Scratch(spark, "points")))


def precluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.precluster(gr.event_positions(_called(spark, sf_dir)))


def merged_breakends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.merge_breakends(gr.event_positions(_called(spark, sf_dir)).where("orientation IN ('+', '-')"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.build_graph(_called(spark, sf_dir), **EDGE)


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with both sides at the mean of their run of positions."""
    called = _called(spark, sf_dir)
    return gr.with_clustered(called, gr.precluster(gr.event_positions(called)))


def clustered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir).select("event_id", "chromx", "x", "chromy", "y", "original_x", "original_y")


def clustered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph over preclustered breakends."""
    return gr.build_graph(_clustered(spark, sf_dir), **EDGE).select("u", "v", "event_id", "shared", "total")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).select("u", "v", "event_id", "shared", "total")


def best_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.best_edges(_graph(spark, sf_dir), Scratch(spark, "best")).select("u", "v", "event_id")


def best_at_both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.best_at_both_ends(_graph(spark, sf_dir)).select("u", "v", "event_id")


def assembled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph after its assembled edges, in the order of their events, have dropped those that compete."""
    scratch = Scratch(spark, "assembled")
    edges = scratch.table(_graph(spark, sf_dir))
    assembled = edges.where("assembled").select("u", "v", F.col("event_id").alias("order"))
    return gr.prefer_assembled(edges, assembled, scratch, min_shared=5).select("u", "v", "event_id")


def facing_breakends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.facing_pairs(gr.event_positions(_called(spark, sf_dir)).select("chrom", "pos", "orientation"))


def _facing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = facing_breakends(spark, sf_dir)
    return pairs.select(gr.node_key("chrom", "left_pos", F.lit("-")).alias("u"), gr.node_key("chrom", "right_pos", F.lit("+")).alias("v"), F.lit("facing").alias("kind"), F.lit(1.0).alias("p"))


def event_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakpoint and facing edges with the component they belong to; as its SQL has it, facing edges by position alone."""
    scratch = Scratch(spark, "components")
    edges = _graph(spark, sf_dir).select("u", "v", F.lit("breakpoint").alias("kind"), F.coalesce("p", F.lit(1.0)).alias("p")).unionByName(_facing_edges(spark, sf_dir))
    return gr.edge_components(scratch.table(edges), scratch)


def _tested_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best breakpoint edges and the facing edges their barcodes support, with the component they belong to."""
    scratch = Scratch(spark, "tested")
    best = scratch.table(gr.best_at_both_ends(gr.build_graph(_clustered(spark, sf_dir), **EDGE)))
    facing = gr.supported_facing_edges(best, va.events(spark, sf_dir), fragments(spark, sf_dir, "dataset", "chrom", "start_pos", "end_pos", "bc", "hap"))
    breakpoints = best.select("u", "v", F.lit("breakpoint").alias("kind"), F.coalesce("p", F.lit(1.0)).alias("p"), "shared", "total")
    return gr.edge_components(scratch.table(breakpoints.unionByName(facing)), scratch)


def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.clean_components(_tested_components(spark, sf_dir))


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.event_paths(clean_events(spark, sf_dir))


def compared_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that have a breakend in common, each beside the first of them, by the barcodes that cross both."""
    ends = su.breakends(va.events(spark, sf_dir)).select("event_id", "chrom", "pos", "orientation").distinct()
    first = ends.groupBy("chrom", "pos", "orientation").agg(F.min("event_id").alias("event_a"))
    pairs = ends.join(first, ["chrom", "pos", "orientation"]).where("event_id <> event_a").select("event_a", F.col("event_id").alias("event_b")).distinct()
    # few events of the test tables are crossed by the same barcodes, so their surroundings are wide
    return gr.compare_breakpoints(pairs, va.events(spark, sf_dir), tips(spark, sf_dir), far=WIDE).withColumn("log_p", F.when(F.col("p") > 0, F.round(F.log10("p"), 4))).drop("p")


def _resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, own = fragments(spark, sf_dir, "dataset", "bc", "num_reads"), tips(spark, sf_dir)
    totals = f.where("bc IS NOT NULL").groupBy("dataset", "bc").agg(F.sum("num_reads").alias("num_reads"))
    crossed = su.quantify(va.events(spark, sf_dir), own).select("event_id", "dataset", "shared", "total", "only_x", "only_y")
    tested = ev.resampling_p(crossed, totals)
    own.forget()  # the events' counts are written
    return tested


def event_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' resampling tests."""
    return _resampled(spark, sf_dir).select("event_id", "dataset", "shared", "total", "p_resampling")


def resampled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' support over the datasets that pass the resampling test."""
    return su.roll_up_samples(_resampled(spark, sf_dir), p="p_resampling")


QUERIES = {q.__name__: q for q in (event_resampling, resampled_samples, end_histogram, background_union, overlap_matrix, marginal_breakpoints, reference_events, peaks, refined_breakends, combined_events, precluster, merged_breakends, clustered_events, clustered_edges, graph_edges, best_edges, best_at_both_ends, assembled_edges, facing_breakends, event_components, clean_events, event_paths, compared_events)}

_PAIRS = va.SQL["fragment_pairs"].replace("SELECT geno_id AS region_id, bc, fx.frag_id AS frag_x, fy.frag_id AS frag_y FROM", ", pairs AS (SELECT geno_id AS region_id, bc, fx.frag_id AS frag_x, fy.frag_id AS frag_y FROM") + ")"
_TIPS = f"""{_PAIRS}, placed AS (SELECT region_id, p.bc, x - {va.PAD} AS sx, y - {va.PAD} AS sy, fx.start_pos AS xs, fx.end_pos AS xe, fy.start_pos AS ys, fy.end_pos AS ye FROM pairs p JOIN frags fx ON fx.frag_id = frag_x JOIN frags fy ON fy.frag_id = frag_y JOIN e ON e.geno_id = region_id),
tips AS (SELECT region_id, bc, o AS orientation, CASE WHEN o[1] = '+' THEN xe ELSE xs END - sx AS tx, CASE WHEN o[2] = '+' THEN ye ELSE ys END - sy AS ty FROM placed, (VALUES ('++'), ('+-'), ('-+'), ('--')) v(o)),
binned AS (SELECT region_id, orientation, bc, least(tx // {BIN}, {2 * va.PAD // BIN - 1}) AS bx, least(ty // {BIN}, {2 * va.PAD // BIN - 1}) AS "by" FROM tips WHERE tx BETWEEN 0 AND {2 * va.PAD} AND ty BETWEEN 0 AND {2 * va.PAD})"""
_EVENTS = "WITH RECURSIVE names AS (SELECT spelling, min_by(chrom, idx) AS name FROM (SELECT chrom, idx, unnest([chrom, alias_name, accession]) AS spelling FROM chroms) GROUP BY spelling), ev AS (SELECT g.* REPLACE (coalesce(nx.name, chromx) AS chromx, coalesce(ny.name, chromy) AS chromy) FROM genotypes g LEFT JOIN names nx ON nx.spelling = chromx LEFT JOIN names ny ON ny.spelling = chromy)"
_ENDS = f"{_EVENTS}, ends AS (SELECT DISTINCT chromx AS chrom, x AS pos, substr(orientation, 1, 1) AS o, assembled FROM ev UNION SELECT DISTINCT chromy, y, substr(orientation, 2, 1), assembled FROM ev WHERE y IS NOT NULL AND chromy IS NOT NULL)"
_GRAPH = f"""{_EVENTS}, good AS (SELECT *, printf('%s:%012d:%s', chromx, x, substr(orientation, 1, 1)) AS a, printf('%s:%012d:%s', chromy, y, substr(orientation, 2, 1)) AS b FROM ev WHERE y IS NOT NULL AND chromy IS NOT NULL AND (p IS NULL OR p <= {EDGE['max_p']}) AND total >= {EDGE['min_total']} AND shared >= {EDGE['min_shared']} AND shared >= total * {EDGE['min_ratio']}
  AND NOT (chromx = chromy AND abs(x - y) < 100000 AND CASE WHEN x <= y THEN substr(orientation, 1, 1) ELSE substr(orientation, 2, 1) END = '-' AND CASE WHEN x <= y THEN substr(orientation, 2, 1) ELSE substr(orientation, 1, 1) END = '+')),
edges AS MATERIALIZED (SELECT least(a, b) AS u, greatest(a, b) AS v, max(geno_id) AS event_id, arg_max(shared, geno_id) AS shared, arg_max(total, geno_id) AS total, arg_max(coalesce(p, 1.0), geno_id) AS p FROM good GROUP BY ALL)"""
_FACING = """SELECT DISTINCT l.chrom, l.pos AS left_pos, r.pos AS right_pos FROM ends l JOIN ends r ON l.chrom = r.chrom AND l.o = '-' AND r.o = '+' AND r.pos - l.pos >= 5000 AND r.pos - l.pos < 100000"""
_RUNS = "SELECT *, sum(CASE WHEN pos - before > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY pos, a ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(pos) OVER (PARTITION BY {by} ORDER BY pos, a) AS before FROM {t})"
_RANKS = "SELECT u, v, event_id, shared / total AS r, row_number() OVER (ORDER BY shared / total DESC, u DESC, v DESC) AS k FROM edges"
#: One edge after the other, with the nodes that are taken.
_WALK = """walk(k, used, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]) UNION ALL
  SELECT r.k, CASE WHEN list_contains(used, u) OR list_contains(used, v) THEN used ELSE list_concat(used, [u, v]) END, CASE WHEN list_contains(used, u) OR list_contains(used, v) THEN taken ELSE list_append(taken, r.k) END FROM walk w JOIN {ranked} r ON r.k = w.k + 1),
done AS (SELECT unnest(taken) AS k FROM walk WHERE k = (SELECT count(*) FROM {ranked}))"""
_CLUSTERED = f"""{_ENDS}, t AS (SELECT DISTINCT chrom, pos, 0 AS a FROM ends), runs AS ({_RUNS.format(gap=3000, by='chrom', t='t')}), means AS (SELECT chrom, pos, CAST(floor(avg(pos) OVER (PARTITION BY chrom, run)) AS BIGINT) AS m FROM runs),
moved AS (SELECT ev.* REPLACE (a.m AS x, b.m AS y), ev.x AS original_x, ev.y AS original_y FROM ev LEFT JOIN means a ON a.chrom = chromx AND a.pos = ev.x LEFT JOIN means b ON b.chrom = chromy AND b.pos = ev.y)"""
_REFINED = va._SUPPORT.format(near=-20_000, far=20_000).replace("bc, hap FROM sides", "bc, start_pos, end_pos FROM sides") + """, spans AS (SELECT event_id, side, pos, o, greatest(start_pos - pos + 20000, 0) AS lo, least(end_pos - pos + 20000, 40001) AS hi FROM near WHERE greatest(start_pos - pos + 20000, 0) < least(end_pos - pos + 20000, 40001)),
pts AS (SELECT DISTINCT event_id, side, pos, o, unnest([0, 40000, lo, lo - 1, hi, hi - 1]) AS spot FROM spans), dens AS (SELECT p.event_id, p.side, p.pos, p.o, p.spot, count(*) FILTER (lo <= p.spot AND hi > p.spot) AS d FROM pts p JOIN spans s USING (event_id, side) WHERE p.spot BETWEEN 0 AND 40000 GROUP BY ALL),
tops AS (SELECT *, max(d) OVER (PARTITION BY event_id, side) AS top FROM dens), peaks AS (SELECT event_id, side, pos, o, CASE o WHEN '+' THEN min(spot) ELSE max(spot) END AS peak FROM tops WHERE d > 0.9 * top GROUP BY event_id, side, pos, o), high AS (SELECT p.*, d AS height FROM peaks p JOIN dens d ON d.event_id = p.event_id AND d.side = p.side AND d.spot = p.peak),
cands AS (SELECT h.*, d.spot, d.d FROM high h JOIN dens d USING (event_id, side) WHERE CASE h.o WHEN '+' THEN d.spot > peak ELSE d.spot < peak END UNION ALL SELECT h.*, peak + 1, height FROM high h WHERE o = '+' AND peak < 40000 AND NOT EXISTS (SELECT 1 FROM dens d WHERE d.event_id = h.event_id AND d.side = h.side AND d.spot = h.peak + 1)),
scored AS (SELECT *, row_number() OVER (PARTITION BY event_id, side ORDER BY (height - d) / sqrt(abs(spot - peak)) DESC, spot) AS k FROM cands), sizes AS (SELECT event_id, side, count(*) AS n FROM spans GROUP BY ALL)
SELECT h.event_id, h.side, h.pos, h.pos - 20000 + coalesce(s.spot, h.peak) AS new_pos, n FROM high h LEFT JOIN (SELECT * FROM scored WHERE k = 1) s USING (event_id, side) JOIN sizes USING (event_id, side)"""
_COMPARED = f"""{va._SUPPORT.format(near=-500, far=WIDE)}, bx AS (SELECT event_id, dataset, bc, count(DISTINCT frag_id) AS n, min(frag_id) AS f FROM near WHERE side = 'x' GROUP BY ALL), by_ AS (SELECT event_id, dataset, bc, count(DISTINCT frag_id) AS n, min(frag_id) AS f FROM near WHERE side = 'y' GROUP BY ALL),
crossing AS (SELECT event_id, dataset, bc FROM bx JOIN by_ USING (event_id, dataset, bc) WHERE NOT (bx.n = 1 AND by_.n = 1 AND bx.f = by_.f)), sizes AS (SELECT event_id, dataset, count(*) AS n FROM crossing GROUP BY ALL), firsts AS (SELECT chrom, pos, o, min(event_id) AS event_a FROM sides GROUP BY ALL),
pairs AS (SELECT DISTINCT event_a, event_id AS event_b FROM sides JOIN firsts USING (chrom, pos, o) WHERE event_id <> event_a),
common AS (SELECT event_a, event_b, dataset, count(*) AS shared FROM pairs JOIN crossing a ON a.event_id = event_a JOIN crossing b USING (dataset, bc) WHERE b.event_id = event_b GROUP BY ALL), good AS (SELECT dataset, count(DISTINCT bc) AS good FROM frags WHERE bc IS NOT NULL GROUP BY dataset),
counts AS (SELECT event_a, event_b, c.dataset, shared, a.n AS na, b.n AS nb, a.n + b.n - shared AS total, good FROM common c JOIN sizes a ON a.event_id = event_a AND a.dataset = c.dataset JOIN sizes b ON b.event_id = event_b AND b.dataset = c.dataset JOIN good g ON g.dataset = c.dataset),
cells AS (SELECT *, unnest(range(shared, least(na, nb) + 1)) AS i FROM counts),
tested AS (SELECT event_a, event_b, dataset, shared, total, least(sum(exp(lgamma(nb + 1) - lgamma(i + 1) - lgamma(nb - i + 1) + lgamma(good - nb + 1) - lgamma(na - i + 1) - lgamma(good - nb - na + i + 1) - lgamma(good + 1) + lgamma(na + 1) + lgamma(good - na + 1))), 1.0) AS p FROM cells GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY event_a, event_b ORDER BY p, dataset) AS k FROM tested) SELECT event_a, event_b, dataset, shared, total, {va._LOG} FROM best WHERE k = 1"""
SQL = {
    "peaks": f"""{_TIPS.replace("WITH ", "WITH RECURSIVE ", 1)}, hist AS (SELECT region_id, orientation, bx, "by", count(*) AS n FROM binned GROUP BY ALL), either AS (SELECT h.region_id, h.orientation, h.bx, h."by", count(DISTINCT b.bc) AS total FROM hist h JOIN binned b ON b.region_id = h.region_id AND b.orientation = h.orientation AND (b.bx = h.bx OR b."by" = h."by") GROUP BY ALL),
cells AS (SELECT region_id, orientation, list({{'bx': bx, 'by': "by", 'n': n, 'r': n / total}} ORDER BY n / total DESC, "by", bx) AS own FROM hist JOIN either USING (region_id, orientation, bx, "by") GROUP BY ALL),
walk(region_id, orientation, own, top) AS (SELECT region_id, orientation, own, CAST(NULL AS STRUCT(bx BIGINT, "by" BIGINT, n BIGINT, r DOUBLE)) FROM cells UNION ALL SELECT region_id, orientation, list_filter(own, lambda c: abs(c.bx - own[1].bx) > 10 OR abs(c.by - own[1].by) > 10), own[1] FROM walk WHERE len(own) > 0 AND own[1].n > 2 AND own[1].r > 0.05)
SELECT region_id, orientation, top.bx AS bx, top.by AS "by", top.n AS n, top.r AS ratio FROM walk WHERE top IS NOT NULL""",
    "reference_events": f"{_EVENTS} SELECT geno_id AS event_id, chromx, chromy FROM ev WHERE chromx IN (SELECT chrom FROM chroms) AND chromy IN (SELECT chrom FROM chroms)",
    "refined_breakends": _REFINED,
    "compared_events": _COMPARED,
    "best_edges": f"{_GRAPH}, ranked AS MATERIALIZED ({_RANKS}), {_WALK.format(ranked='ranked')} SELECT u, v, event_id FROM ranked JOIN done USING (k)",
    "assembled_edges": f"""{_GRAPH}, ranked AS MATERIALIZED (SELECT u, v, event_id, row_number() OVER (ORDER BY event_id, u DESC, v DESC) AS k FROM edges JOIN genotypes ON geno_id = event_id WHERE genotypes.assembled AND edges.shared >= 5 AND edges.shared / edges.total >= 0.05), {_WALK.format(ranked='ranked')},
first AS (SELECT u, v, event_id FROM ranked JOIN done USING (k)), nodes AS (SELECT u AS node FROM first UNION SELECT v FROM first) SELECT * FROM first UNION ALL SELECT u, v, event_id FROM edges WHERE u NOT IN (SELECT node FROM nodes) AND v NOT IN (SELECT node FROM nodes)""",
    "clustered_events": f"{_CLUSTERED} SELECT geno_id AS event_id, chromx, x, chromy, y, original_x, original_y FROM moved",
    "clustered_edges": f"""{_CLUSTERED}, {_GRAPH[len(_EVENTS) + 2:].replace("FROM ev WHERE", "FROM moved WHERE")} SELECT u, v, event_id, shared, total FROM edges""",
    "end_histogram": f'{_TIPS} SELECT region_id, orientation, bx, "by", count(*) AS n FROM binned GROUP BY ALL',
    "background_union": f"""{_TIPS}, hist AS (SELECT region_id, orientation, bx, "by", count(*) AS n FROM binned GROUP BY ALL), either AS (SELECT h.region_id, h.orientation, h.bx, h."by", count(DISTINCT b.bc) AS total FROM hist h JOIN binned b ON b.region_id = h.region_id AND b.orientation = h.orientation AND (b.bx = h.bx OR b."by" = h."by") GROUP BY ALL)
SELECT * FROM hist JOIN either USING (region_id, orientation, bx, "by")""",
    "overlap_matrix": f"""{_TIPS}, xs AS (SELECT *, unnest(range(CAST(greatest(floor((xs - sx) / {BIN}), 0) AS BIGINT), CAST(least(floor((xe - 1 - sx) / {BIN}), {2 * va.PAD // BIN - 1}) AS BIGINT) + 1)) AS bx FROM placed),
xy AS (SELECT *, unnest(range(CAST(greatest(floor((ys - sy) / {BIN}), 0) AS BIGINT), CAST(least(floor((ye - 1 - sy) / {BIN}), {2 * va.PAD // BIN - 1}) AS BIGINT) + 1)) AS "by" FROM xs) SELECT region_id, bx, "by", count(*) AS n FROM xy GROUP BY ALL""",
    "combined_events": f"""{_EVENTS}, pts AS MATERIALIZED (SELECT * FROM ev WHERE y IS NOT NULL AND chromy IS NOT NULL), near AS MATERIALIZED (SELECT a.geno_id AS u, b.geno_id AS v FROM pts a JOIN pts b ON a.chromx = b.chromx AND a.chromy = b.chromy AND a.orientation = b.orientation AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 25000000),
reach(e, other) AS (SELECT geno_id, geno_id FROM pts UNION SELECT r.e, n.v FROM reach r JOIN near n ON n.u = r.other), comp AS (SELECT e, min(other) AS cluster FROM reach GROUP BY e)
SELECT comp.cluster, chromx, chromy, orientation, CAST(floor(avg(x)) AS BIGINT) AS x, CAST(floor(avg(y)) AS BIGINT) AS y, count(*) AS n FROM pts JOIN comp ON e = geno_id GROUP BY ALL""",
    "precluster": f"{_ENDS}, t AS (SELECT DISTINCT chrom, pos, 0 AS a FROM ends), runs AS ({_RUNS.format(gap=3000, by='chrom', t='t')}) SELECT chrom, pos, CAST(floor(avg(pos) OVER (PARTITION BY chrom, run)) AS BIGINT) AS clustered FROM runs",
    "merged_breakends": f"""{_ENDS}, t AS (SELECT DISTINCT chrom, pos, o, coalesce(assembled, false) AS a FROM ends WHERE o IN ('+', '-')), runs AS ({_RUNS.format(gap=5000, by='chrom, o', t='t')}), means AS (SELECT chrom, o, run, max(a) AS has, CAST(floor(avg(pos)) AS BIGINT) AS m FROM runs GROUP BY ALL)
SELECT chrom, pos, o AS orientation, a AS assembled FROM runs WHERE a UNION ALL SELECT chrom, m, o, false FROM means WHERE NOT has""",
    "graph_edges": f"{_GRAPH} SELECT u, v, event_id, shared, total FROM edges",
    "best_at_both_ends": f"""{_GRAPH}, ends AS (SELECT u AS node, u, v, shared / total AS r FROM edges UNION ALL SELECT v, u, v, shared / total FROM edges), top AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY r DESC, u DESC, v DESC) AS k FROM ends)
SELECT e.u, e.v, e.event_id FROM edges e WHERE (SELECT count(*) FROM top t WHERE t.u = e.u AND t.v = e.v AND k = 1) = 2""",
    "facing_breakends": f"{_ENDS} {_FACING}",
    "event_components": f"""{_GRAPH}, ends AS (SELECT DISTINCT chromx AS chrom, x AS pos, substr(orientation, 1, 1) AS o FROM ev UNION SELECT DISTINCT chromy, y, substr(orientation, 2, 1) FROM ev WHERE y IS NOT NULL AND chromy IS NOT NULL),
every AS MATERIALIZED (SELECT u, v, 'breakpoint' AS kind, p FROM edges UNION ALL SELECT printf('%s:%012d:-', chrom, left_pos), printf('%s:%012d:+', chrom, right_pos), 'facing', 1.0 FROM ({_FACING})),
both_ways AS MATERIALIZED (SELECT u, v FROM every UNION SELECT v, u FROM every), reach(n, other) AS (SELECT u, u FROM both_ways UNION SELECT r.n, b.v FROM reach r JOIN both_ways b ON b.u = r.other), comp AS (SELECT n, min(other) AS cluster FROM reach GROUP BY n)
SELECT u, v, kind, p, cluster FROM every JOIN comp ON n = u""",
}

_MATRIX = SQL["overlap_matrix"].replace(") SELECT region_id, bx, \"by\", count(*) AS n FROM xy GROUP BY ALL", "), cells AS (SELECT region_id, bx, \"by\", count(*) AS n FROM xy GROUP BY ALL)")
_SIDE = """{s}m AS (SELECT region_id, {b} AS b, max(n) AS m FROM cells GROUP BY ALL), {s}p AS (SELECT region_id, max(m) AS top, arg_min(b, (-m, b)) AS peak FROM {s}m GROUP BY region_id),
{s}f AS (SELECT q.region_id, i AS b, peak, CASE WHEN i = peak THEN 0.0 ELSE (top - coalesce(m, 0)) / sqrt(abs(i - peak)) END AS fall FROM (SELECT *, unnest(range({bins})) AS i FROM {s}p) q LEFT JOIN {s}m m ON m.region_id = q.region_id AND m.b = i),
{s}b AS (SELECT region_id, b, peak, row_number() OVER (PARTITION BY region_id ORDER BY fall DESC, b) AS k FROM {s}f)"""
SQL["marginal_breakpoints"] = f"""{_MATRIX}, {_SIDE.format(s="x", b="bx", bins=2 * va.PAD // BIN)}, {_SIDE.format(s="y", b='"by"', bins=2 * va.PAD // BIN)}
SELECT region_id, e.x - {va.PAD} + xb.b * {BIN} AS x, e.y - {va.PAD} + yb.b * {BIN} AS y, CASE WHEN xb.b > xb.peak THEN '+' ELSE '-' END || CASE WHEN yb.b > yb.peak THEN '+' ELSE '-' END AS orientation FROM xb JOIN yb USING (region_id) JOIN e ON e.geno_id = region_id WHERE xb.k = 1 AND yb.k = 1"""
