"""Covers (c, node): completion, overlaps, suppression of near-duplicates, module networks and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.storage import written
from loomgraph.operators.graph import both_ways


def complete(cover: DataFrame, everyone: DataFrame, mode: str = "new_cluster") -> DataFrame:
    """A partition (c, node): a node's last community wins; uncovered nodes form one more, or join the last one ("last")."""
    last = cover.groupBy("node").agg(F.max("c").alias("c"))
    extra = cover.agg((F.coalesce(F.max("c"), F.lit(0)) + (1 if mode == "new_cluster" else 0)).alias("extra"))
    return everyone.select("node").join(last, "node", "left").crossJoin(F.broadcast(extra)).select(F.coalesce("c", "extra").alias("c"), "node")


def overlapping(cover: DataFrame) -> DataFrame:
    """(node, n): nodes in two or more communities."""
    return cover.distinct().groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")


def sizes(cover: DataFrame) -> DataFrame:
    return cover.distinct().groupBy("c").agg(F.count("*").alias("size"))


def overlaps(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(c1, c2, shared, n1, n2, jaccard) of communities that share a node; of one cover, c1 < c2. An equi-join on the node."""
    same = b is None
    a = a.distinct()
    b = a if same else b.distinct()
    pairs = a.toDF("c1", "node").join(b.toDF("c2", "node"), "node")
    if same:
        pairs = pairs.filter("c1 < c2")
    shared = pairs.groupBy("c1", "c2").agg(F.count("*").alias("shared"))
    out = shared.join(sizes(a).toDF("c1", "n1"), "c1").join(sizes(b).toDF("c2", "n2"), "c2")
    return out.select("c1", "c2", "shared", "n1", "n2", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("jaccard"))


def similar(cover: DataFrame, least: float = 0.49999) -> DataFrame:
    """(c1, c2, share) of overlaps that hold at least that share of the smaller community."""
    return overlaps(cover).withColumn("share", F.col("shared") / F.least("n1", "n2")).filter(F.col("share") >= least).select("c1", "c2", "share")


def suppress(cover: DataFrame, scores: DataFrame, least: float = 0.49999, rounds: int = 1000) -> DataFrame:
    """cover without communities contained in a larger one that stays (or an equal one of lower score, then id).

    Greedy by size descending, score, id, in rounds: those without an undecided better rival stay, their rivals go.
    """
    n = sizes(cover).join(scores.select("c", "score"), "c", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    key = F.struct((-F.col("size")).alias("s"), F.col("score"), F.col("c"))
    keys = n.select("c", key.alias("key"))
    pairs = overlaps(cover).filter(F.col("shared") >= least * F.least("n1", "n2")).select("c1", "c2")
    pairs = pairs.join(keys.toDF("c1", "k1"), "c1").join(keys.toDF("c2", "k2"), "c2")
    rival = written(pairs.select(F.when(F.col("k1") < F.col("k2"), F.col("c1")).otherwise(F.col("c2")).alias("better"), F.when(F.col("k1") < F.col("k2"), F.col("c2")).otherwise(F.col("c1")).alias("worse")), "rivals")
    undecided, gone = rival, None
    for _ in range(rounds):
        if not undecided.limit(1).count():
            break
        stay = undecided.select(F.col("better").alias("c")).distinct().join(undecided.select(F.col("worse").alias("c")), "c", "left_anti")
        out = undecided.join(stay.toDF("better"), "better", "left_semi").select(F.col("worse").alias("c")).distinct()
        out = written(out, "gone")
        gone = out if gone is None else gone.union(out)
        done = written(stay.union(out), "decided")
        undecided = written(undecided.join(done.toDF("worse"), "worse", "left_anti").join(done.toDF("better"), "better", "left_anti"), "rivals")
    return cover if gone is None else cover.join(gone, "c", "left_anti")


def module_network(edges: DataFrame, cover: DataFrame, digits: int = 9) -> DataFrame:
    """(c1, c2, n), c1 < c2: the sum over links between modules of 1 / (memberships of both ends), rounded half up, above 0."""
    k = cover.distinct().withColumn("o", F.count("*").over(Window.partitionBy("node")))
    a, b = k.toDF("c1", "node", "o1"), k.toDF("c2", "neighbor", "o2")
    m = F.col("mult") if "mult" in edges.columns else F.lit(1)
    ends = edges.select("src", "dst", m.alias("m"))
    ends = ends.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), "m").union(ends.select("dst", "src", "m"))
    sums = ends.join(a, "node").join(b, "neighbor").filter("c1 < c2").groupBy("c1", "c2").agg(F.sum(F.col("m") / (F.col("o1") * F.col("o2"))).alias("w"))
    return sums.select("c1", "c2", F.floor(F.round("w", digits) + 0.5).cast("long").alias("n")).filter("n > 0")


def translate(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """A cover (c, node) of modules as one of the modules' nodes; lower: (c, node) whose c are upper's nodes."""
    return upper.withColumnRenamed("node", "m").join(lower.select(F.col("c").alias("m"), "node"), "m").select("c", "node").distinct()


def pooled(*covers: DataFrame) -> DataFrame:
    """One cover of all communities, numbered on; communities with the same nodes once."""
    shift, parts = 0, []
    for cover in covers:
        parts.append(cover.select((F.col("c") + shift).alias("c"), "node"))
        shift += int(cover.agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]) + 1
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.union(p)
    all_ = all_.distinct()
    mark = all_.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("b"))
    return all_.join(mark.groupBy("n", "a", "b").agg(F.min("c").alias("c")).select("c"), "c", "left_semi")


def homeless(cover: DataFrame, everyone: DataFrame) -> DataFrame:
    """(node): nodes of no module, or only of modules of one node."""
    housed = cover.distinct().join(sizes(cover).filter("size > 1"), "c", "left_semi").select("node")
    return everyone.select("node").join(housed, "node", "left_anti")


def neighbor_modules(edges: DataFrame, cover: DataFrame, who: DataFrame) -> DataFrame:
    """(node, c, links): how many links each of the nodes has to each module."""
    ends = both_ways(edges).join(who.select("node"), "node", "left_semi")
    return ends.join(cover.distinct().withColumnRenamed("node", "neighbor"), "neighbor").groupBy("node", "c").agg(F.count("*").alias("links"))


def split_components(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(c, part, node): each community's connected parts, named by their smallest node."""
    from loomgraph.operators.graph import components
    from loomgraph.functions.storage import numbered

    ids = written(numbered(cover.distinct(), "c", "node", name="id", first=0), "members")
    a = ids.select("c", F.col("node").alias("src"), F.col("id").alias("i"))
    b = ids.select("c", F.col("node").alias("dst"), F.col("id").alias("j"))
    inner = edges.select("src", "dst").join(a, "src").join(b, ["c", "dst"]).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    parts = components(inner, ids.select(F.col("id").alias("node")))
    first = ids.select(F.col("id").alias("component"), F.col("node").alias("part"))
    return parts.withColumnRenamed("node", "id").join(ids, "id").join(first, "component").select("c", "part", "node")
