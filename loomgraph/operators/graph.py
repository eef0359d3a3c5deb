"""Graphs as edge tables: canonical edges under the engines' duplicate policies, degrees, subgraphs, searches, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.storage import laid_out, numbered, parts, written


def canonical(edges: DataFrame, duplicates: str = "drop", loops: str = "drop") -> DataFrame:
    """(src, dst, mult, weight) with src <= dst; edges: src, dst and optionally weight, mult.

    duplicates: "drop" (weight 1), "first" (smallest weight stands for the first read), "sum" or "keep"; loops: "drop" or "keep".
    """
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    m = F.col("mult") if "mult" in edges.columns else F.lit(1)
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), m.cast("int").alias("mult"), w.cast("double").alias("weight"))
    if loops == "drop":
        e = e.filter("src <> dst")
    if duplicates == "keep":
        return e
    how = {"drop": (F.lit(1), F.lit(1.0)), "first": (F.min("mult"), F.min("weight")), "sum": (F.sum("mult").cast("int"), F.sum("weight"))}[duplicates]
    return e.groupBy("src", "dst").agg(how[0].alias("mult"), how[1].alias("weight"))


def with_ids(edges: DataFrame) -> DataFrame:
    """(edge_id, src, dst): distinct canonical edges numbered from 1 in order of (src, dst)."""
    return written(numbered(canonical(edges).select("src", "dst"), "src", "dst", name="edge_id"), "edges").select("edge_id", "src", "dst")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions: (node, neighbor) and weight if there is one."""
    more = ["weight"] if "weight" in edges.columns else []
    one = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), *more)
    return one.union(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbor"), *more))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def strengths(edges: DataFrame) -> DataFrame:
    """(node, stubs, strength): the sums of multiplicities and weights."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), "mult", "weight").groupBy("node").agg(F.sum("mult").alias("stubs"), F.sum("weight").alias("strength"))


def relabelled(edges: DataFrame) -> DataFrame:
    """(src, dst, node_src, node_dst): nodes numbered from 0 in ascending order."""
    ids = numbered(nodes(edges), "node", name="id", first=0)
    a = ids.select(F.col("node").alias("node_src"), F.col("id").alias("src"))
    b = ids.select(F.col("node").alias("node_dst"), F.col("id").alias("dst"))
    return edges.select(F.col("src").alias("node_src"), F.col("dst").alias("node_dst")).join(a, "node_src").join(b, "node_dst").select("src", "dst", "node_src", "node_dst")


def numbered_edges(edges: DataFrame, by_degree: bool = False) -> DataFrame:
    """(src, dst), src < dst: distinct edges without loops by their nodes' numbers from 0, in ascending order of nodes, or of degrees and nodes."""
    m = edges.count()
    every, order = (degrees(edges), ("degree", "node")) if by_degree else (nodes(edges), ("node",))
    ids = numbered(every, *order, name="id", first=0, rows=min(2 * m, every.count())).select("node", "id")
    n = parts(edges, m)
    one = edges.select("src", "dst").repartition(n, "src").join(ids.toDF("src", "a"), "src").select("dst", "a")
    two = one.repartition(n, "dst").join(ids.toDF("dst", "b"), "dst")
    return two.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in members (node)."""
    m = members.select("node").distinct()
    out = edges.join(m.withColumnRenamed("node", "src"), "src", "left_semi")
    return out.join(m.withColumnRenamed("node", "dst"), "dst", "left_semi").select(edges.columns)


def inner_degrees(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(c, node, k_in, k) of each member: its neighbors in the community and all."""
    ends = both_ways(edges)
    inside = ends.join(cover.select("c", "node"), "node").join(cover.select("c", F.col("node").alias("neighbor")), ["c", "neighbor"], "left_semi")
    k_in = inside.groupBy("c", "node").agg(F.count("*").alias("k_in"))
    out = cover.select("c", "node").distinct().join(k_in, ["c", "node"], "left").join(degrees(edges), "node", "left")
    return out.select("c", "node", F.coalesce("k_in", F.lit(0)).cast("long").alias("k_in"), F.coalesce("degree", F.lit(0)).cast("long").alias("k"))


def search(links: DataFrame, sources: DataFrame, rounds: int = 1_000_000, counted: bool = False) -> DataFrame:
    """Breadth-first search from every source at once: (source, node, d), and walks, the number of shortest ones, if counted.

    links: (node, neighbor), both directions; sources: (node). Each round joins only the frontier and anti-joins what is known.
    """
    links = links.select("node", "neighbor").distinct()
    frontier = written(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("d"), F.lit(1).cast("decimal(38,0)").alias("walks")).distinct(), "search")
    known = frontier
    for d in range(1, rounds + 1):
        step = frontier.join(links, "node").groupBy("source", F.col("neighbor").alias("node")).agg(F.sum("walks").cast("decimal(38,0)").alias("walks"))
        step = step.join(known.select("source", "node"), ["source", "node"], "left_anti")
        frontier = written(step.select("source", "node", F.lit(d).alias("d"), "walks"), "search")
        if not frontier.limit(1).count():
            return known if counted else known.drop("walks")
        known = known.union(frontier)
    return known if counted else known.drop("walks")


def components(edges: DataFrame, among: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node it reaches; among: nodes to list even if they have no edge.

    Large-star and small-star contraction; groups are only ever aggregated, and every round is a written table.
    """
    everyone = nodes(edges) if among is None else nodes(edges).union(among.select("node")).distinct()
    now = written(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "stars")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = written(hung.union(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return everyone.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def giant(edges: DataFrame) -> DataFrame:
    """Edges of the component with the most nodes, the smallest one of equals."""
    c = components(edges)
    best = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return induced(edges, c.join(F.broadcast(best), "component", "left_semi"))


def pagerank(edges: DataFrame, alpha: float = 0.15, rounds: int = 200, tolerance: float = 1e-12, teleport: DataFrame | None = None) -> DataFrame:
    """(node, rank): the steady state of a directed walk (src, dst, weight); dangling mass and jumps follow teleport (node, weight)."""
    every = written(nodes(edges), "nodes")
    jump = every.withColumn("t", F.lit(1.0)) if teleport is None else every.join(teleport.select("node", F.col("weight").alias("t")), "node", "left").na.fill(0.0)
    total = jump.agg(F.sum("t")).first()[0] or 1.0
    jump = written(jump.select("node", (F.col("t") / total).alias("t")), "teleport")
    links = edges.filter("src <> dst").select("src", "dst", "weight")
    w = links.repartition(parts(edges, edges.count()), "src").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = written(w.groupBy("src").agg(F.sum("w").alias("out")), "out")
    flow = laid_out(w.join(out.hint("shuffle_hash"), "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")), "src")
    dangling = written(every.join(out.select(F.col("src").alias("node")), "node", "left_anti"), "dangling")
    rank = jump.select("node", F.col("t").alias("rank"))
    for _ in range(rounds):
        lost = rank.join(dangling, "node").agg(F.sum("rank")).first()[0] or 0.0
        moved = flow.join(rank.withColumnRenamed("node", "src").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("in"))
        new = jump.join(moved, "node", "left").select("node", (F.lit(alpha) * F.col("t") + (1 - alpha) * (F.coalesce("in", F.lit(0.0)) + F.lit(lost) * F.col("t"))).alias("rank"))
        new = written(new, "rank")
        change = new.join(rank.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        rank = new
        if change < tolerance:
            break
    flow.unpersist()
    return rank
