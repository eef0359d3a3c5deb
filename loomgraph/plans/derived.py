"""Graphs and covers from the driver's tables, and the same as SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.storage import numbered, parts, written
from loomgraph.operators import graph, linegraph
from loomgraph.operators.medoids import DIGITS
from loomgraph.plans import known


@lru_cache(64)
def co_part(spark: SparkSession, sf_dir: str, orders: int) -> DataFrame:
    """(edge_id, src, dst): parts that stand together in at least that many orders."""
    return _edges(_together(spark, sf_dir, orders))


def _together(spark: SparkSession, sf_dir: str, orders: int, within: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight), src < dst: parts in at least that many orders together, and in how many; within: (p, kin), pairs of a kin only.

    An order's items are dealt once, over as many tasks as the rows ask for; so are the pairs, which are aggregated where they arrive,
    since few of them are met twice.
    """
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows, keys = lineitem.count(), ["o"] if within is None else ["o", "kin"]
    items = lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    items = (items if within is None else items.join(within, "p")).repartition(parts(lineitem, rows), *keys).distinct()
    pairs = items.withColumnRenamed("p", "src").join(items.withColumnRenamed("p", "dst"), keys).filter("src < dst").select("src", "dst")
    counted = pairs.repartition(parts(lineitem, 4 * rows), "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return counted.filter(F.col("weight") >= orders)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, p, low): the distinct parts of orders of at least two, and the smallest of the order."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    items = lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).na.drop()
    items = items.repartition(parts(lineitem, lineitem.count()), "o")
    ends = items.groupBy("o").agg(F.min("p").alias("low"), F.max("p").alias("high")).filter("low < high")
    return items.join(ends, "o").select("o", "p", "low")


@lru_cache(64)
def co_nodes(spark: SparkSession, sf_dir: str, orders: int) -> DataFrame:
    """(node): the nodes of co_part; those of any order are told without its pairs."""
    return written(_items(spark, sf_dir).select(F.col("p").alias("node")).distinct() if orders == 1 else graph.nodes(co_part(spark, sf_dir, orders)), "nodes")


def co_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each part of an order with its smallest one. An order's parts all stand together, so nodes and components are those of
    co_part over any order."""
    return _items(spark, sf_dir).filter("low < p").select(F.col("low").alias("src"), F.col("p").alias("dst"))


def _edges(pairs: DataFrame) -> DataFrame:
    """(edge_id, src, dst) of distinct pairs src < dst, numbered in order."""
    pairs = written(pairs.select("src", "dst"), "pairs")
    return written(numbered(pairs, "src", "dst", name="edge_id", rows=pairs.count()).select("edge_id", "src", "dst"), "edges")


@lru_cache(64)
def lines_of(spark: SparkSession, sf_dir: str, orders: int) -> DataFrame:
    return written(linegraph.line_graph(co_part(spark, sf_dir, orders)), "lines")


@lru_cache(64)
def steps_of(spark: SparkSession, sf_dir: str, orders: int) -> DataFrame:
    """Steps in the line graph from every link to all it reaches, itself too."""
    sources = co_part(spark, sf_dir, orders).select(F.col("edge_id").alias("node"))
    return written(graph.search(linegraph.line_links(lines_of(spark, sf_dir, orders)), sources), "steps")


@lru_cache(64)
def weighted(spark: SparkSession, sf_dir: str, orders: int = 2) -> DataFrame:
    """(src, dst, weight): parts in at least that many orders together, and in how many."""
    return written(_together(spark, sf_dir, orders).select("src", "dst", F.col("weight").cast("double").alias("weight")), "weighted")


@lru_cache(64)
def kin_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, src, dst): parts of one brand and one half of the sizes that stand together in any order: a graph of many components,
    with more links the more orders there are."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat("p_brand", F.when(F.col("p_size") > 25, "+").otherwise("-")).alias("kin"))
    return _edges(_together(spark, sf_dir, 1, part.toDF("p", "kin")))


@lru_cache(64)
def kin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(linegraph.line_graph(kin_part(spark, sf_dir)), "lines")


def club(spark: SparkSession) -> DataFrame:
    """(edge_id, src, dst): the karate club, small enough for every distance and for the exact search."""
    return graph.with_ids(spark.createDataFrame(known.links(known.KARATE), "src long, dst long"))


def sizes_cover(spark: SparkSession, sf_dir: str, orders: int = 2) -> DataFrame:
    """(c, node): the graph's parts by size, a partition."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("long").alias("c"), F.col("p_partkey").alias("node"))
    return part.join(co_nodes(spark, sf_dir, orders), "node", "left_semi").select("c", "node")


def brands_cover(spark: SparkSession, sf_dir: str, orders: int = 2) -> DataFrame:
    """(c, node): the graph's parts by the digits of their brand, and parts above size 25 in a community of their type's length too."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    brand = part.select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("c"), F.col("p_partkey").alias("node"))
    kind = part.filter("p_size > 25").select((F.length("p_type") + 1000).cast("long").alias("c"), F.col("p_partkey").alias("node"))
    return brand.union(kind).join(co_nodes(spark, sf_dir, orders), "node", "left_semi").select("c", "node").distinct()


def sql(orders: int = 2, *more: str) -> str:
    """WITH e (edge_id, src, dst), w (src, dst, weight), n (node), inc (edge_id, node), b (node, other) and more tables."""
    return _tables(f"""li AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
w AS (SELECT a.p AS src, b.p AS dst, CAST(count(*) AS DOUBLE) AS weight FROM li a JOIN li b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= {orders})""", more)


def kin_sql(*more: str) -> str:
    """The same tables of the links within a brand and one half of the sizes."""
    return _tables("""li AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, p_brand AS brand, p_size > 25 AS half FROM lineitem JOIN part ON p_partkey = l_partkey),
w AS (SELECT a.p AS src, b.p AS dst, CAST(count(*) AS DOUBLE) AS weight FROM li a JOIN li b ON a.o = b.o AND a.brand = b.brand AND a.half = b.half AND a.p < b.p GROUP BY 1, 2)""", more)


def club_sql(*more: str) -> str:
    """The same tables of the links of the karate club."""
    values = ", ".join(f"({a}, {b}, 1.0)" for a, b in known.links(known.KARATE))
    return _tables(f"w AS (SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(weight AS DOUBLE) AS weight FROM (VALUES {values}) t(src, dst, weight))", more)


def _tables(w: str, more: tuple[str, ...]) -> str:
    return f"""
WITH RECURSIVE {w},
e AS (SELECT row_number() OVER (ORDER BY src, dst) AS edge_id, src, dst FROM w),
n AS (SELECT DISTINCT node FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e)),
inc AS (SELECT edge_id, src AS node FROM e UNION ALL SELECT edge_id, dst FROM e),
b AS (SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e),
k AS (SELECT node, count(*) AS degree FROM inc GROUP BY 1)
{"".join(", " + m for m in more)}
"""


LINES = "l AS (SELECT DISTINCT x.edge_id AS e1, y.edge_id AS e2 FROM inc x JOIN inc y ON x.node = y.node AND x.edge_id < y.edge_id)"
SIZES = "s AS (SELECT CAST(p_size AS BIGINT) AS c, p_partkey AS node FROM part WHERE p_partkey IN (SELECT node FROM n))"
BRANDS = """r AS (SELECT DISTINCT c, node FROM (SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS c, p_partkey AS node FROM part
UNION ALL SELECT CAST(length(p_type) + 1000 AS BIGINT), p_partkey FROM part WHERE p_size > 25) WHERE node IN (SELECT node FROM n))"""


def reach(sources: str = "TRUE") -> str:
    """SQL table sp (e1, e2, d): steps in the line graph from the links e1 that meet the condition to all they reach."""
    return f"""ll AS (SELECT e1 AS u, e2 AS v FROM l UNION ALL SELECT e2, e1 FROM l),
reach(s, v, d) USING KEY (s, v) AS (SELECT edge_id, edge_id, 0 FROM e WHERE {sources}
UNION SELECT reach.s, ll.v, min(reach.d + 1) FROM reach JOIN ll ON reach.v = ll.u LEFT JOIN recurring.reach AS old ON old.s = reach.s AND old.v = ll.v WHERE old.s IS NULL GROUP BY 1, 2),
sp AS (SELECT s AS e1, v AS e2, d FROM reach)"""


LINE_PARTS = "ll AS (SELECT e1 AS u, e2 AS v FROM l UNION ALL SELECT e2, e1 FROM l), lc AS (SELECT edge_id AS x, edge_id AS v FROM e UNION SELECT lc.x, ll.v FROM lc JOIN ll ON ll.u = lc.v), pt AS (SELECT x AS id, min(v) AS part FROM lc GROUP BY 1)"
PARTS = "cc AS (SELECT node, node AS v FROM n UNION SELECT cc.node, b.other FROM cc JOIN b ON b.node = cc.v), pn AS (SELECT node, min(v) AS part FROM cc GROUP BY 1)"

# resistances rs (e1, e2, r) of the line graph: the Laplacian plus J/n is inverted block by block, a pivot a round
RESISTANCES = """nq AS (SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY id) AS q, count(*) OVER (PARTITION BY part) AS size FROM pt),
lk AS (SELECT u, CAST(count(*) AS DOUBLE) AS g FROM ll GROUP BY 1),
m0 AS (SELECT x.part, x.size, x.q AS i, y.q AS j, 1.0 / x.size + CASE WHEN x.q = y.q THEN coalesce(lk.g, 0) WHEN ll.u IS NOT NULL THEN -1.0 ELSE 0.0 END AS a
FROM nq x JOIN nq y ON x.part = y.part LEFT JOIN ll ON ll.u = x.id AND ll.v = y.id LEFT JOIN lk ON lk.u = x.id),
gj AS (SELECT 0 AS k, part, size, i, j, a FROM m0 UNION ALL SELECT g.k + 1, g.part, g.size, g.i, g.j,
CASE WHEN g.i = g.k + 1 AND g.j = g.k + 1 THEN 1 / p.a WHEN g.i = g.k + 1 THEN g.a / p.a WHEN g.j = g.k + 1 THEN -g.a / p.a ELSE g.a - c.a * o.a / p.a END
FROM gj g JOIN gj p ON p.part = g.part AND p.i = g.k + 1 AND p.j = g.k + 1 JOIN gj c ON c.part = g.part AND c.i = g.i AND c.j = g.k + 1
JOIN gj o ON o.part = g.part AND o.i = g.k + 1 AND o.j = g.j WHERE g.k < g.size),
iv AS (SELECT x.id AS e1, y.id AS e2, a FROM gj JOIN nq x ON x.part = gj.part AND x.q = gj.i JOIN nq y ON y.part = gj.part AND y.q = gj.j WHERE k = gj.size),
rs AS (SELECT z.e1, z.e2, x.a + y.a - 2 * z.a AS r FROM iv z JOIN iv x ON x.e1 = z.e1 AND x.e2 = z.e1 JOIN iv y ON y.e1 = z.e2 AND y.e2 = z.e2 WHERE z.e1 < z.e2)"""

GENERALISED = """g AS (SELECT s AS e, d AS k, sum(c) AS g FROM wk WHERE d > 0 GROUP BY 1, 2), sh AS (SELECT e, k, g / sum(g) OVER (PARTITION BY k) AS s FROM g),
t AS (SELECT x.e AS e1, y.e AS e2, sum(x.k * x.s * y.s) AS d FROM sh x JOIN sh y ON x.k = y.k AND x.e < y.e GROUP BY 1, 2),
gd AS (SELECT x.edge_id AS e1, y.edge_id AS e2, coalesce(t.d, 0) AS d FROM e x JOIN e y ON x.edge_id < y.edge_id LEFT JOIN t ON t.e1 = x.edge_id AND t.e2 = y.edge_id)"""
COMMUTE = "cm AS (SELECT e1, e2, sqrt(greatest(2.0 * (SELECT count(*) FROM l) * r, 0)) AS d FROM rs)"
AMPLIFIED = """q2 AS (SELECT rs.e1, rs.e2, r - 1 / x.g - 1 / y.g + CASE WHEN l.e1 IS NULL THEN 0 ELSE 2 / (x.g * y.g) END AS d2
FROM rs JOIN lk x ON x.u = rs.e1 JOIN lk y ON y.u = rs.e2 LEFT JOIN l ON l.e1 = rs.e1 AND l.e2 = rs.e2), am AS (SELECT e1, e2, CASE WHEN abs(d2) <= 1e-12 THEN 0 WHEN d2 > 0 THEN sqrt(d2) END AS d FROM q2)"""


def digits(x: str) -> str:
    """SQL of a number in the significant digits in which distances are compared."""
    unit = f"pow(10, {DIGITS - 1} - floor(log10({x})))"
    return f"CASE WHEN {x} = 0 THEN 0 ELSE round({x} * {unit}) / {unit} END"


def two_medoids_each(distance: str) -> str:
    """SQL tables as of two_medoids for every component pn of the graph; a component of one link is a cluster."""
    return f"""ep AS (SELECT edge_id, part FROM e JOIN pn ON pn.node = e.src),
dd AS (SELECT ep.part, x, y, {digits('d')} AS d FROM (SELECT e1 AS x, e2 AS y, d FROM {distance} UNION ALL SELECT e2, e1, d FROM {distance} UNION ALL SELECT edge_id, edge_id, 0.0 FROM e) JOIN ep ON ep.edge_id = x),
co AS (SELECT p.part, p.y AS m1, q.y AS m2, sum(least(p.d, q.d)) AS cost FROM dd p JOIN dd q ON p.part = q.part AND p.x = q.x AND p.y < q.y GROUP BY 1, 2, 3),
md AS (SELECT unnest(b) AS m FROM (SELECT first([m1, m2] ORDER BY {digits('cost')}, m1, m2) AS b FROM co GROUP BY part) UNION ALL SELECT min(edge_id) FROM ep GROUP BY part HAVING count(*) = 1),
a AS (SELECT x AS edge_id, first(y ORDER BY d, y) AS cluster_id FROM dd JOIN md ON md.m = dd.y GROUP BY x),
rk AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS c FROM (SELECT DISTINCT cluster_id FROM a)),
mb AS (SELECT node, c, count(*) AS n_edges FROM inc JOIN a USING (edge_id) JOIN rk USING (cluster_id) GROUP BY 1, 2),
bl AS (SELECT node, c, n_edges, n_edges / sum(n_edges) OVER (PARTITION BY node) AS belonging FROM mb)"""


def two_medoids(distance: str) -> str:
    """SQL tables a (edge_id, cluster_id) and bl (node, c, n_edges, belonging): all pairs of medoids tried, numbers in DIGITS digits."""
    return f"""dd AS (SELECT x, y, {digits('d')} AS d FROM (SELECT e1 AS x, e2 AS y, d FROM {distance} UNION ALL SELECT e2, e1, d FROM {distance} UNION ALL SELECT edge_id, edge_id, 0.0 FROM e)),
co AS (SELECT p.y AS m1, q.y AS m2, sum(least(p.d, q.d)) AS cost FROM dd p JOIN dd q ON p.x = q.x AND p.y < q.y GROUP BY 1, 2),
md AS (SELECT m1, m2 FROM co ORDER BY {digits('cost')}, m1, m2 LIMIT 1),
a AS (SELECT p.x AS edge_id, CASE WHEN q.d < p.d THEN m2 ELSE m1 END AS cluster_id FROM md JOIN dd p ON p.y = m1 JOIN dd q ON q.y = m2 AND q.x = p.x),
mb AS (SELECT node, dense_rank() OVER (ORDER BY cluster_id) AS c, n_edges FROM (SELECT node, cluster_id, count(*) AS n_edges FROM inc JOIN a USING (edge_id) GROUP BY 1, 2)),
bl AS (SELECT node, c, n_edges, n_edges / sum(n_edges) OVER (PARTITION BY node) AS belonging FROM mb)"""


# number c of shortest walks wk (s, v, d, c) of each length in the line graph
WALKS = "wk AS (SELECT edge_id AS s, edge_id AS v, 0 AS d, CAST(1 AS DOUBLE) AS c FROM e UNION ALL SELECT wk.s, ll.v, wk.d + 1, sum(wk.c) FROM wk JOIN ll ON ll.u = wk.v JOIN sp ON sp.e1 = wk.s AND sp.e2 = ll.v AND sp.d = wk.d + 1 GROUP BY 1, 2, 3)"

# maximal cliques mc (m), sorted lists of at least three nodes
CLIQUES = """nb AS (SELECT node, list(other) AS o FROM b GROUP BY 1),
ck AS (SELECT [node] AS m, o AS com FROM nb UNION ALL SELECT list_append(m, x), list_intersect(com, nb.o) FROM (SELECT m, com, unnest(com) AS x FROM ck) JOIN nb ON nb.node = x WHERE x > m[-1]),
mc AS (SELECT m FROM ck WHERE len(com) = 0 AND len(m) >= 3)"""


def ranks(rounds: int) -> str:
    """SQL table rk (node, r): PageRank of the directed weighted graph after that many rounds, jumps 0.15 to all nodes alike."""
    return f"""ow AS (SELECT src, sum(weight) AS ow FROM w GROUP BY 1), fl AS (SELECT src, dst, weight / ow AS p FROM w JOIN ow USING (src)),
pr AS (SELECT 0 AS i, node, CAST(1 AS DOUBLE) / (SELECT count(*) FROM n) AS r FROM n UNION ALL SELECT z.i + 1, n.node, 0.15 / z.nn + 0.85 * (coalesce(t.x, 0) + z.lost / z.nn)
FROM n CROSS JOIN (SELECT max(i) AS i, count(*) AS nn, coalesce(sum(CASE WHEN ow.src IS NULL THEN r END), 0) AS lost FROM pr LEFT JOIN ow ON ow.src = pr.node) z
LEFT JOIN (SELECT fl.dst AS node, sum(fl.p * pr.r) AS x FROM fl JOIN pr ON pr.node = fl.src GROUP BY 1) t ON t.node = n.node WHERE z.i < {rounds}), rk AS (SELECT node, r FROM pr WHERE i = {rounds})"""


def inner(cover: str) -> str:
    """SQL tables kin (c, node, k_in, k) and cnt (c, n_c, m_c, cut) of a cover's table."""
    return f"""kin AS (SELECT x.c, x.node, count(y.node) AS k_in, any_value(k.degree) AS k FROM {cover} x JOIN k ON k.node = x.node
LEFT JOIN b ON b.node = x.node LEFT JOIN {cover} y ON y.c = x.c AND y.node = b.other GROUP BY 1, 2),
cnt AS (SELECT c, count(*) AS n_c, CAST(sum(k_in) // 2 AS BIGINT) AS m_c, CAST(sum(k - k_in) AS BIGINT) AS cut FROM kin GROUP BY 1),
sz AS (SELECT count(*) AS n FROM n), m AS (SELECT count(*) AS m FROM e)"""
