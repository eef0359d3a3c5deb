"""Registered queries of Leiden, clean-up and significant modules, and of relational operators over all orders.

These take the parts that stand together in any order (115,729 links at sf0.01, 1.2 million at sf0.1) where nothing else is said, so
their work grows with lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.storage import written
from loomgraph.operators import cleanup, cover, detect, draws, egos, graph, metrics, modules, paths, sided, significance
from loomgraph.operators import leiden as leidens
from loomgraph.plans.derived import BRANDS, SIZES, brands_cover, co_part, co_stars, inner, ranks, sizes_cover, sql, weighted
from loomgraph.plans.queries import ORACLES, query, rounded

# ---- relational operators over all orders ----


@query(sql(1) + "SELECT node, degree FROM k")
def degree_all(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(co_part(spark, d, 1))


@query(sql(1, "lo(i, node, c) AS (SELECT 0, node, node FROM n UNION ALL SELECT i + 1, node, min(c) FROM (SELECT lo.i, b.node, lo.c FROM lo JOIN b ON b.other = lo.node WHERE lo.i < 40 UNION ALL SELECT lo.i, lo.node, lo.c FROM lo WHERE lo.i < 40) GROUP BY i, node)") + "SELECT node, c AS component FROM lo WHERE i = 40")
def components_all(spark, d):  # noqa: ANN001, ANN201
    """Components of the graph of any order, by the stars of its orders."""
    return graph.components(co_stars(spark, d))


@query(sql(1, ranks(20)) + "SELECT node, round(r, 9) AS rank FROM rk")
def pagerank_all(spark, d):  # noqa: ANN001, ANN201
    """Twenty rounds of PageRank over weighted links, from the smaller to the larger part."""
    return rounded(graph.pagerank(weighted(spark, d, 1), rounds=20, tolerance=0.0), 9)


@query(sql(1, "t AS (SELECT x.node, count(*) AS closed FROM b x JOIN b y ON y.node = x.node AND x.other < y.other JOIN e ON e.src = x.other AND e.dst = y.other GROUP BY 1)")
       + "SELECT k.node, degree, coalesce(closed, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(closed, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS coefficient FROM k LEFT JOIN t USING (node)")
def clustering_all(spark, d):  # noqa: ANN001, ANN201
    return rounded(metrics.clustering(co_part(spark, d, 1)))


@query(sql(1, BRANDS, "o AS (SELECT c, node, count(*) OVER (PARTITION BY node) AS o FROM r)")
       + "SELECT x.c AS c1, y.c AS c2, CAST(floor(round(sum(1.0 / (x.o * y.o)), 9) + 0.5) AS BIGINT) AS n FROM b JOIN o x ON x.node = b.node JOIN o y ON y.node = b.other WHERE x.c < y.c GROUP BY 1, 2 HAVING floor(round(sum(1.0 / (x.o * y.o)), 9) + 0.5) > 0")
def module_network_all(spark, d):  # noqa: ANN001, ANN201
    return cover.module_network(co_part(spark, d, 1), brands_cover(spark, d, 1))


@query(sql(1, SIZES, inner("s")) + "SELECT c, node, CAST(k_in AS BIGINT) AS k_in, CAST(k AS BIGINT) AS k FROM kin")
def inner_degrees_all(spark, d):  # noqa: ANN001, ANN201
    return graph.inner_degrees(co_part(spark, d, 1), sizes_cover(spark, d, 1))


@query(sql(1, "vb AS (SELECT node, other FROM b UNION ALL SELECT node, node FROM n), lp AS (SELECT 0 AS i, node, node AS c FROM n UNION ALL SELECT i + 1, node, first(c ORDER BY k DESC, c) FROM (SELECT lp.i, vb.node, lp.c, count(*) AS k FROM vb JOIN lp ON lp.node = vb.other WHERE lp.i < 12 GROUP BY 1, 2, 3) GROUP BY i, node)") + "SELECT c, node FROM lp WHERE i = 12")
def label_propagation_all(spark, d):  # noqa: ANN001, ANN201
    return detect.label_propagation(co_part(spark, d, 1), 12)


# ---- Leiden ----


@query()
def leiden(spark, d):  # noqa: ANN001, ANN201
    return leidens.leiden(co_part(spark, d, 1))


_MOVES = """, tk AS (SELECT s.c, sum(k.degree) AS tot, count(*) AS size FROM s JOIN k USING (node) GROUP BY 1), m2 AS (SELECT CAST(sum(degree) AS DOUBLE) AS m2 FROM k),
li2 AS (SELECT x.node, x.c AS own, y.c AS c, count(*) AS w FROM b JOIN s x ON x.node = b.node JOIN s y ON y.node = b.other GROUP BY 1, 2, 3 UNION ALL SELECT node, c, c, 0 FROM s),
gn AS (SELECT node, own, c, round(sum(w) - any_value(k.degree) * (any_value(tk.tot) - CASE WHEN own = c THEN any_value(k.degree) ELSE 0 END) / any_value(m2), 10) AS gain
FROM li2 JOIN k USING (node) JOIN tk USING (c) CROSS JOIN m2 GROUP BY node, own, c)"""


@query(sql(1, SIZES).rstrip() + _MOVES + " SELECT node, first(c ORDER BY gain DESC, (c = own) DESC, c) AS c FROM gn GROUP BY node")
def best_moves(spark, d):  # noqa: ANN001, ANN201
    """A step of local moving from the sizes of parts, all nodes in one colour: where each node would gain most."""
    level = leidens._Level(co_part(spark, d, 1))
    moved = level.move(sizes_cover(spark, d, 1).select("node", "c"), 0, 1, 1.0, 0)
    level.close()
    return moved


# ---- clean-up ----

# for modules s: nodes outside that touch one, their tail and mass under the configuration model, and the order statistics of the middles
_BORDER = """, kb AS (SELECT x.c, x.node, count(y.node) AS k_in FROM s x LEFT JOIN b ON b.node = x.node LEFT JOIN s y ON y.c = x.c AND y.node = b.other GROUP BY 1, 2),
ms AS (SELECT kb.c, sum(k.degree) - sum(k_in) AS free, (SELECT sum(degree) FROM k) - sum(k.degree) AS total, (SELECT count(*) FROM n) - count(*) AS outside FROM kb JOIN k USING (node) GROUP BY 1),
ou AS (SELECT y.c, b.node, count(*) AS k_in FROM b JOIN s y ON y.node = b.other LEFT JOIN s x ON x.node = b.node AND x.c = y.c WHERE x.c IS NULL GROUP BY 1, 2),
bs AS (SELECT ou.c, ou.node, k.degree AS k, k_in, CAST(free AS BIGINT) AS free, CAST(total AS BIGINT) AS total, CAST(outside AS BIGINT) AS outside,
lgamma(free + 1) + lgamma(total - free + 1) + lgamma(k.degree + 1) + lgamma(total - k.degree + 1) - lgamma(total + 1) AS base FROM ou JOIN ms USING (c) JOIN k USING (node)),
mass AS (SELECT *, list_transform(range(k_in, least(k, free) + 1), lambda x: exp(base - lgamma(x + 1) - lgamma(free - x + 1) - lgamma(k - x + 1) - lgamma(total - free - k + x + 1))) AS p FROM bs),
sc AS (SELECT c, node, k, k_in, free, total, outside, coalesce(list_sum(p[2:]), 0) AS tail, coalesce(p[1], 0) AS now FROM mass)"""


@query(sql(2, SIZES).rstrip() + _BORDER + " SELECT c, node, k, k_in, free, total, outside, round(tail, 6) AS tail, round(now, 6) AS now FROM sc")
def border_scores(spark, d):  # noqa: ANN001, ANN201
    """How unlikely the links of each node outside are that touch a module, the parts of a size."""
    modules_ = sizes_cover(spark, d).select(F.lit(0).cast("long").alias("g"), "c", "node")
    return rounded(cleanup.border_scores(cleanup.of_edges(co_part(spark, d, 2)), modules_)).drop("g")


_TEST = """, ra AS (SELECT c, node, outside, tail + 0.5 * now AS r, row_number() OVER (PARTITION BY c ORDER BY tail + 0.5 * now, node) AS q FROM sc WHERE tail <= 0.1),
os AS (SELECT *, CASE WHEN q <= outside * r THEN 1.0 ELSE list_sum(list_transform(range(q, outside + 1), lambda i: exp(lgamma(outside + 1) - lgamma(i + 1) - lgamma(outside - i + 1) + i * ln(r) + (outside - i) * ln(1 - r)))) END AS oc,
-ln(0.9) / CASE WHEN outside > 100 THEN 4.2 * ln(outside) - 8.5 WHEN outside > 30 THEN 3.5 * ln(outside) - 5.5 WHEN outside > 7 THEN 2.5 * ln(outside) - 2 WHEN outside > 1 THEN 1.3 * ln(outside) + 0.1 ELSE 1 END AS xi FROM ra),
fi AS (SELECT c, min(q) AS f FROM os WHERE oc < xi GROUP BY 1), la AS (SELECT fi.c, coalesce(min(q) FILTER (oc >= xi AND q > f), max(q) + 1) AS stop FROM fi JOIN os USING (c) GROUP BY 1, f)"""


_RINGS = "s AS (SELECT b.node AS c, b.other AS node FROM b JOIN k ON k.node = b.node WHERE degree >= 6)"


@query(sql(2, _RINGS).rstrip() + _BORDER + _TEST + " SELECT c, node, round((SELECT oc FROM os z WHERE z.c = os.c AND z.q = stop - 1), 6) AS order_c FROM os JOIN la USING (c) WHERE q < stop")
def module_borders(spark, d):  # noqa: ANN001, ANN201
    """The significant border of each neighborhood of six and more nodes, without its ego, by order statistics of ranks: one round of
    clean-up with scores in the middle."""
    e = co_part(spark, d, 2)
    rings = graph.both_ways(e).join(graph.degrees(e).filter("degree >= 6"), "node").select(F.lit(0).cast("long").alias("g"), F.col("node").alias("c"), F.col("neighbor").alias("node"))
    scores = written(cleanup.border_scores(cleanup.of_edges(e), rings), "border-scores")
    found = cleanup.borders(scores, scores.select("g", "c", F.lit(0).alias("run")).distinct(), 0, middle=True)
    return rounded(found.select("c", "node", "order_c"))


@query()
def checked_groups(spark, d):  # noqa: ANN001, ANN201
    """Groups under the null model, cleaned with no nodes but their own."""
    net = cleanup.of_edges(co_part(spark, d, 2))
    return rounded(cleanup.clean_up(net, modules.label_groups(net), "check").select("c", "node", "score"), 9)


@query()
def gathered_modules(spark, d):  # noqa: ANN001, ANN201
    """One search: cleaned groups, inflated ones and unions of those discarded."""
    return rounded(modules.gathered(cleanup.of_edges(co_part(spark, d, 2))).select("c", "node", "score"), 9)


@query()
def fused_modules(spark, d):  # noqa: ANN001, ANN201
    """Components split by Leiden, those fused that form a significant module of the module network."""
    e = co_part(spark, d, 2)
    return significance.fuse(e, written(leidens.leiden(e), "communities"))


# the same for directed links w with weights: a score a side by counts, then the gamma tail of weights, then both sides together
_SIDES = """, hl AS (SELECT src AS node, dst AS other, 'o' AS s, weight FROM w UNION ALL SELECT dst, src, 'i', weight FROM w),
hs AS (SELECT node, s, count(*) AS k, avg(weight) AS mean FROM hl GROUP BY 1, 2), sd AS (SELECT * FROM (VALUES ('o', 'i'), ('i', 'o')) t(s, os)),
cs AS (SELECT s.c, hs.s, sum(k) AS tot FROM s JOIN hs USING (node) GROUP BY 1, 2), cn AS (SELECT c, (SELECT count(*) FROM n) - count(*) AS outside FROM s GROUP BY 1),
il AS (SELECT x.c, count(*) AS kin FROM w JOIN s x ON x.node = w.src JOIN s y ON y.node = w.dst AND y.c = x.c GROUP BY 1),
ou AS (SELECT y.c, hl.node, hl.s, count(*) AS x, sum(hl.weight / hs.mean) AS heavy FROM hl JOIN hs USING (node, s) JOIN s y ON y.node = hl.other LEFT JOIN s z ON z.node = hl.node AND z.c = y.c WHERE z.c IS NULL GROUP BY 1, 2, 3),
os AS (SELECT t.c, t.node, sd.s, coalesce(hs.k, 0) AS k, coalesce(ou.x, 0) AS x, coalesce(ou.heavy, 0) AS heavy, CAST(coalesce(p.tot, 0) - coalesce(kin, 0) AS BIGINT) AS free, CAST((SELECT count(*) FROM w) - coalesce(q.tot, 0) AS BIGINT) AS total
FROM (SELECT DISTINCT c, node FROM ou) t CROSS JOIN sd LEFT JOIN ou ON ou.c = t.c AND ou.node = t.node AND ou.s = sd.s LEFT JOIN hs ON hs.node = t.node AND hs.s = sd.s
LEFT JOIN cs p ON p.c = t.c AND p.s = sd.os LEFT JOIN cs q ON q.c = t.c AND q.s = sd.s LEFT JOIN il ON il.c = t.c),
ob AS (SELECT *, lgamma(least(free, total) + 1) + lgamma(total - least(free, total) + 1) + lgamma(k + 1) + lgamma(total - k + 1) - lgamma(total + 1) AS base FROM os),
op AS (SELECT *, list_transform(range(x, least(k, free) + 1), lambda i: CASE WHEN total - least(free, total) - k + i < 0 THEN 0 ELSE exp(base - lgamma(i + 1) - lgamma(least(free, total) - i + 1) - lgamma(k - i + 1) - lgamma(total - least(free, total) - k + i + 1)) END) AS p FROM ob),
ot AS (SELECT *, greatest(least(coalesce(list_sum(p[2:]), 0) + 0.5 * coalesce(p[1], 0), 1), 1e-100) AS a, CASE WHEN x = 0 THEN 1 ELSE list_sum(list_transform(range(0, x), lambda i: exp(i * ln(heavy) - heavy - lgamma(i + 1)))) END AS h FROM op),
oz AS (SELECT *, a * h * (1 - ln(a * h)) AS z FROM ot)"""


@query(sql(2, SIZES).rstrip() + _SIDES + " SELECT x.c, x.node, x.k AS k_out, x.x AS x_out, x.free AS free_out, x.total AS total_out, y.k AS k_in, y.x AS x_in, y.free AS free_in, y.total AS total_in, CAST(outside AS BIGINT) AS outside, round(x.z * y.z * (1 - ln(x.z * y.z)), 6) AS score FROM oz x JOIN oz y ON x.s = 'o' AND y.s = 'i' AND y.c = x.c AND y.node = x.node JOIN cn ON cn.c = x.c")
def directed_border_scores(spark, d):  # noqa: ANN001, ANN201
    """border_scores with links from the smaller to the larger part, weighted by common orders."""
    model = sided.Sided(weighted(spark, d), directed=True, weighted=True)
    return rounded(sided.border_scores(model, sizes_cover(spark, d).select(F.lit(0).cast("long").alias("g"), "c", "node")).drop("g"))


@query()
def directed_modules(spark, d):  # noqa: ANN001, ANN201
    """Significant modules of the weighted links from the smaller to the larger part."""
    return rounded(sided.significant(weighted(spark, d), True, True).select("c", "node", "score"), 9)


# ---- ego networks, distances ----

_PERSONAS = """eg AS (SELECT x.node AS ego, x.other AS i, y.other AS j FROM b x JOIN b y ON y.node = x.node JOIN b z ON z.node = x.other AND z.other = y.other),
pp AS (SELECT 0 AS r, node AS ego, other AS v, other AS part FROM b UNION ALL SELECT r + 1, ego, v, min(part) FROM (SELECT r, ego, v, part FROM pp WHERE r < 12
UNION ALL SELECT r, pp.ego, eg.j, part FROM pp JOIN eg ON eg.ego = pp.ego AND eg.i = pp.v WHERE r < 12) GROUP BY r, ego, v), ps AS (SELECT ego AS node, v AS neighbor, part FROM pp WHERE r = 12)"""


@query(sql(2, _PERSONAS) + "SELECT e.src, x.part AS src_part, e.dst, y.part AS dst_part FROM e JOIN ps x ON x.node = e.src AND x.neighbor = e.dst JOIN ps y ON y.node = e.dst AND y.neighbor = e.src")
def persona_graph(spark, d):  # noqa: ANN001, ANN201
    return egos.persona_graph(co_part(spark, d, 2))


ORACLES["ego_modules"] = sql(2, _PERSONAS, "bg AS (SELECT ps.* FROM ps JOIN k USING (node) WHERE degree > 10)") + "SELECT node AS ego, part, neighbor AS node FROM bg UNION ALL SELECT DISTINCT node, part, node FROM bg"


@query()
def ego_splitting(spark, d):  # noqa: ANN001, ANN201
    return egos.ego_splitting(co_part(spark, d, 2))


@query()
def demon(spark, d):  # noqa: ANN001, ANN201
    return egos.demon(co_part(spark, d, 1))


@query(sql(1, BRANDS, "z AS (SELECT c, count(*) AS n FROM r GROUP BY 1)") + "SELECT x.c AS c1, y.c AS c2, count(*) AS shared, any_value(a.n) AS n1, any_value(z.n) AS n2 FROM r x JOIN r y ON y.node = x.node AND x.c <> y.c JOIN z a ON a.c = x.c JOIN z ON z.c = y.c WHERE a.n < z.n OR a.n = z.n AND x.c > y.c GROUP BY 1, 2 HAVING count(*) >= 0.2 * any_value(a.n) - 1e-9")
def contained_communities(spark, d):  # noqa: ANN001, ANN201
    """Communities of which a fifth or more lies in a larger one."""
    return egos.contained(brands_cover(spark, d, 1), 0.2)


@query()
def neighborhood_function(spark, d):  # noqa: ANN001, ANN201
    return rounded(paths.neighborhood_function(co_part(spark, d, 1)))


@query()
def path_estimates(spark, d):  # noqa: ANN001, ANN201
    return rounded(paths.path_estimates(paths.neighborhood_function(co_part(spark, d, 1))))


@query(sql(1, "dd AS (SELECT degree AS value, count(*) AS weight FROM k GROUP BY 1), cu AS (SELECT value, sum(weight) OVER (ORDER BY value) AS upto, weight, sum(weight) OVER () AS total FROM dd)")
       + "SELECT p_partkey AS node, value AS degree FROM (SELECT p_partkey, ((p_partkey * 7919) % 10007 + 0.5) / 10007 AS u FROM part) JOIN cu ON u >= (upto - weight) / total AND u < upto / total")
def drawn_degrees(spark, d):  # noqa: ANN001, ANN201
    """A degree for each part, drawn from the distribution of degrees."""
    degrees = graph.degrees(co_part(spark, d, 1)).groupBy(F.col("degree").alias("value")).agg(F.count("*").alias("weight"))
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("node"), ((F.col("p_partkey") * 7919 % 10007 + 0.5) / 10007).alias("u"))
    return draws.drawn(parts, degrees).select("node", F.col("value").alias("degree"))
