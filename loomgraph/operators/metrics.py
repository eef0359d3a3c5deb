"""Quality of covers, similarity of covers, and statistics of graphs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from loomgraph.functions.storage import numbered, parts, written
from loomgraph.operators.cover import overlapping, sizes
from loomgraph.operators.graph import both_ways, degrees, inner_degrees, numbered_edges


def choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def community_counts(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(c, n_c, m_c, cut): nodes, inner links and boundary links of each community."""
    k = inner_degrees(edges, cover)
    return k.groupBy("c").agg(F.count("*").alias("n_c"), (F.sum("k_in") / 2).cast("long").alias("m_c"), F.sum(F.col("k") - F.col("k_in")).cast("long").alias("cut"))


def community_scores(edges: DataFrame, cover: DataFrame, n: int | None = None) -> DataFrame:
    """One row for each community: edges_inside, size, average_internal_degree, internal_edge_density (as recorded, and true_density),
    conductance, cut_ratio, expansion, normalized_cut, avg_embeddedness, fraction_over_median_degree, scaled_density.

    Undefined ratios are 0.
    """
    m = edges.count()
    n = edges.select(F.explode(F.array("src", "dst"))).distinct().count() if n is None else n
    k = inner_degrees(edges, cover)
    inner = k.groupBy("c").agg(F.avg(F.coalesce(F.try_divide("k_in", "k"), F.lit(0.0))).alias("avg_embeddedness"), F.percentile("k_in", F.lit(0.5)).alias("median"))
    over = k.join(inner, "c").groupBy("c").agg(F.avg((F.col("k_in") > F.col("median")).cast("double")).alias("fraction_over_median_degree"))
    x = community_counts(edges, cover).join(inner.drop("median"), "c").join(over, "c")
    m_c, n_c, cut = F.col("m_c"), F.col("n_c"), F.col("cut")
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    density = zero(m_c, choose2(n_c))
    return x.select(
        "c",
        m_c.cast("double").alias("edges_inside"),
        n_c.cast("double").alias("size"),
        (2 * m_c / n_c).alias("average_internal_degree"),
        (density / 4).alias("internal_edge_density"),
        density.alias("true_density"),
        zero(cut, 2 * m_c + cut).alias("conductance"),
        zero(cut, n_c * (n - n_c)).alias("cut_ratio"),
        (cut / n_c).alias("expansion"),
        (zero(cut, 2 * m_c + cut) + zero(cut, 2 * (m - m_c) + cut)).alias("normalized_cut"),
        "avg_embeddedness",
        "fraction_over_median_degree",
        (n_c * density).alias("scaled_density"),
    )


def quality(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(metric, value): means of the community scores, and modularity density, significance (published, and with m for n), surprise."""
    scores = community_scores(edges, cover)
    names = [c for c in scores.columns if c != "c"]
    means = scores.agg(*[F.avg(c).alias(c) for c in names])
    m = edges.count()
    n = edges.select(F.explode(F.array("src", "dst"))).distinct().count()
    counts = community_counts(edges, cover)
    kl = lambda q, p: F.when(q > 0, q * F.ln(q / p)).otherwise(0.0) + F.when(q < 1, (1 - q) * F.ln((1 - q) / (1 - p))).otherwise(0.0)
    pairs = choose2(F.col("n_c"))
    q = F.coalesce(F.try_divide(F.col("m_c").cast("double"), pairs), F.lit(0.0))
    sig = lambda p: F.sum(F.when(pairs > 0, pairs * kl(q, F.lit(p))).otherwise(0.0))
    whole = counts.agg(
        F.sum((2 * F.col("m_c") - F.col("cut")) / F.col("n_c") ** 2).alias("modularity_density"),
        sig(m / (n * (n - 1) / 2)).alias("significance"),
        sig(m / (m * (m - 1) / 2)).alias("significance_recorded"),
        (F.sum("m_c") / m).alias("_q"),
        (F.sum(pairs) / (n * (n - 1) / 2)).alias("_e"),
    )
    whole = whole.withColumn("surprise", m * kl(F.least("_q", F.lit(1.0)), F.least("_e", F.lit(1 - 1e-12)))).drop("_q", "_e")
    return means.crossJoin(whole).unpivot([], [*names, "modularity_density", "significance", "significance_recorded", "surprise"], "metric", "value")


def modularity(edges: DataFrame, cover: DataFrame, t: float = 1.0) -> DataFrame:
    """(q): Newman's modularity of a cover; with Markov time t, (1 - t) + sum of t in/2m - (tot/2m)^2."""
    m2 = 2.0 * edges.count()
    k = inner_degrees(edges, cover).groupBy("c").agg(F.sum("k_in").alias("i"), F.sum("k").alias("a"))
    return k.agg((F.lit(1.0 - t) + F.sum(t * F.col("i") / m2 - (F.col("a") / m2) ** 2)).alias("q"))


def extended_modularity(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(eq): modularity whose pairs are divided by the memberships of both nodes."""
    m2 = 2.0 * edges.count()
    o = cover.distinct().withColumn("o", F.count("*").over(Window.partitionBy("node")))
    inner = both_ways(edges).select("node", "neighbor").join(o, "node").join(o.toDF("c", "neighbor", "o2"), ["c", "neighbor"])
    a = inner.groupBy("c").agg(F.sum(1 / (F.col("o") * F.col("o2"))).alias("a"))
    k = o.join(degrees(edges), "node").groupBy("c").agg(F.sum(F.col("degree") / F.col("o")).alias("k"))
    return k.join(a, "c", "left").agg((F.sum(F.coalesce("a", F.lit(0.0)) - F.col("k") ** 2 / m2) / m2).alias("eq"))


def pair_similarity(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(c1, c2, similarity), c1 < c2: links between two communities less those expected, over twice the links."""
    m2 = 2.0 * edges.count()
    k = cover.distinct().join(degrees(edges), "node", "left").na.fill(0, ["degree"])
    total = k.groupBy("c").agg(F.sum("degree").alias("k"), F.count("*").alias("n"))
    links = both_ways(edges).select("node", "neighbor").join(cover.distinct().toDF("c1", "node"), "node").join(cover.distinct().toDF("c2", "neighbor"), "neighbor")
    links = links.filter("c1 < c2").groupBy("c1", "c2").agg(F.count("*").alias("a"))
    both = k.toDF("node", "c1", "d").join(k.select(F.col("c").alias("c2"), "node"), "node").filter("c1 < c2").groupBy("c1", "c2").agg(F.sum(F.col("d") * F.col("d")).alias("same"))
    pairs = total.toDF("c1", "k1", "n1").join(total.toDF("c2", "k2", "n2"), F.col("c1") < F.col("c2"))  # the result's own size
    pairs = pairs.join(links, ["c1", "c2"], "left").join(both, ["c1", "c2"], "left").na.fill(0, ["a", "same"])
    return pairs.select("c1", "c2", ((F.col("a") - (F.col("k1") * F.col("k2") - F.col("same")) / m2) / m2).alias("similarity"))


# ---- similarity of covers ----


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """(nmi) of two partitions of the same nodes; -2 if both have one class."""
    cells = a.toDF("i", "node").join(b.toDF("j", "node"), "node").groupBy("i", "j").agg(F.count("*").alias("x"))
    n = F.sum("x").over(Window.partitionBy())
    rows = cells.groupBy("i").agg(F.sum("x").alias("r"))
    cols = cells.groupBy("j").agg(F.sum("x").alias("q"))
    total = cells.agg(F.sum("x").alias("n"))
    up = cells.join(rows, "i").join(cols, "j").crossJoin(F.broadcast(total)).agg(F.sum(F.col("x") * F.ln(F.col("x") * F.col("n") / (F.col("r") * F.col("q")))).alias("u"))
    down = lambda t, c: t.crossJoin(F.broadcast(total)).agg(F.sum(F.col(c) * F.ln(F.col(c) / F.col("n"))).alias(f"d{c}"))
    del n
    one = up.crossJoin(down(rows, "r")).crossJoin(down(cols, "q"))
    return one.select(F.when(F.col("dr") + F.col("dq") == 0, -2.0).otherwise(-2 * F.col("u") / (F.col("dr") + F.col("dq"))).alias("nmi"))


def _h(x: Column) -> Column:
    return F.when(x > 0, -x * F.log2(x)).otherwise(0.0)


def _conditional(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """(c1, h, best): each community's entropy, and its least conditional entropy given one of b (h if none is telling)."""
    a, b = a.distinct().toDF("c1", "node"), b.distinct().toDF("c2", "node")
    sa, sb = a.groupBy("c1").agg(F.count("*").alias("n1")), b.groupBy("c2").agg(F.count("*").alias("n2"))
    shared = a.join(b, "node").groupBy("c1", "c2").agg(F.count("*").alias("s"))
    pairs = sa.crossJoin(F.broadcast(sb)).join(shared, ["c1", "c2"], "left").na.fill(0, ["s"])  # all pairs of communities, by definition
    p11, p10, p01 = F.col("s") / n, (F.col("n1") - F.col("s")) / n, (F.col("n2") - F.col("s")) / n
    p00 = 1 - p11 - p10 - p01
    h1 = _h(F.col("n1") / n) + _h(1 - F.col("n1") / n)
    joint = _h(p11) + _h(p10) + _h(p01) + _h(F.greatest(p00, F.lit(0.0)))
    given = joint - _h(F.col("n2") / n) - _h(1 - F.col("n2") / n)
    telling = _h(p11) + _h(F.greatest(p00, F.lit(0.0))) >= _h(p10) + _h(p01)
    return pairs.withColumn("h", h1).withColumn("g", F.when(telling, F.greatest(given, F.lit(0.0))).otherwise(h1)).groupBy("c1").agg(F.first("h").alias("h"), F.min("g").alias("best"))


def onmi_lfk(a: DataFrame, b: DataFrame) -> DataFrame:
    """(onmi): overlapping normalised mutual information by normalised conditional entropies, over the nodes of both covers."""
    n = a.select("node").union(b.select("node")).distinct().count()
    ratio = F.when(F.col("h") <= 1e-15, 1.0).otherwise(F.col("best") / F.col("h"))
    side = lambda x, y, name: _conditional(x, y, n).agg(F.coalesce(F.avg(ratio), F.lit(1.0)).alias(name))
    return side(a, b, "x").crossJoin(side(b, a, "y")).select((0.5 * (2 - F.col("x") - F.col("y"))).alias("onmi"))


def onmi_max(a: DataFrame, b: DataFrame) -> DataFrame:
    """(onmi): mutual information over the larger entropy."""
    n = a.select("node").union(b.select("node")).distinct().count()
    side = lambda x, y, p: _conditional(x, y, n).agg(F.sum("h").alias(f"h{p}"), F.sum("best").alias(f"g{p}"))
    one = side(a, b, "a").crossJoin(side(b, a, "b"))
    info = 0.5 * (F.col("ha") - F.col("ga") + F.col("hb") - F.col("gb"))
    return one.select(F.coalesce(F.try_divide(info, F.greatest("ha", "hb")), F.lit(0.0)).alias("onmi"))


def f1_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(f1, nf1): the mean F1 of each found community with the true one most members are in; times coverage over redundancy."""
    a, b = found.distinct().toDF("c1", "node"), truth.distinct().toDF("c2", "node")
    sa, sb = a.groupBy("c1").agg(F.count("*").alias("n1")), b.groupBy("c2").agg(F.count("*").alias("n2"))
    shared = a.join(b, "node").groupBy("c1", "c2").agg(F.count("*").alias("s")).join(sa, "c1").join(sb, "c2")
    best = shared.groupBy("c1").agg(F.max_by(F.struct("c2", "s", "n1", "n2"), F.struct("s", (-F.col("n2")).alias("a"), (-F.col("c2")).alias("b"))).alias("m")).select("c1", "m.*")
    p, r = F.col("s") / F.col("n1"), F.col("s") / F.col("n2")
    all_ = sa.join(best.select("c1", "c2", (2 * p * r / (p + r)).alias("f")), "c1", "left")
    counts = all_.agg(F.avg(F.coalesce("f", F.lit(0.0))).alias("f1"), F.count_distinct("c2").alias("hit"), F.count("*").alias("n"))
    return counts.crossJoin(sb.agg(F.count("*").alias("t"))).select("f1", F.coalesce(F.try_divide(F.col("f1") * (F.col("hit") / F.col("t")), F.col("n") / F.col("hit")), F.lit(0.0)).alias("nf1"))


def shared_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, k): how many pairs of nodes share x communities of a and y of b, x + y > 0.

    Nodes of the same communities are alike, so classes of them are paired instead of nodes; those of at most one community in either cover,
    all nodes of two partitions, are counted by the sizes of communities and of what they share, and no pairs of them are made.
    """
    sets = lambda x, name: x.distinct().toDF("c", "node").filter("node is not null").groupBy("node").agg(F.sort_array(F.collect_list("c")).alias(name))
    classes = sets(a, "p").join(sets(b, "q"), "node", "full").groupBy("p", "q").agg(F.count("*").alias("n"))
    length = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "p", "q", length("p").alias("x"), length("q").alias("y"), "n")
    classes = written(classes, "classes")
    pairs = F.expr("sum(n * (n - 1) div 2)").alias("k")
    alike = classes.groupBy("x", "y").agg(pairs)

    simple = classes.filter("x <= 1 and y <= 1")
    side = lambda c, x: simple.filter(F.col(x) == 1).groupBy(c).agg(F.sum("n").alias("n")).agg(F.coalesce(pairs, F.lit(0)).alias(c))
    cells = simple.agg(*[F.coalesce(F.expr(f"sum(case when {w} then n * (n - 1) div 2 end)"), F.lit(0)).alias(c) for c, w in (("pq", "x = 1 and y = 1"), ("op", "x = 1 and y = 0"), ("oq", "x = 0 and y = 1"))])
    one = side("p", "x").crossJoin(side("q", "y")).crossJoin(cells)
    unlike = one.select(F.expr("explode(array(named_struct('x', 1L, 'y', 0L, 'k', p - pq - op), named_struct('x', 0L, 'y', 1L, 'k', q - pq - oq)))").alias("s")).select("s.*")

    def met(c: str, x: int) -> DataFrame:
        held = classes.select("id", "n", ((F.col("x") > 1) | (F.col("y") > 1)).alias("more"), F.explode(c).alias("c"))
        both = held.filter("more").drop("more").toDF("i", "ni", "c").join(held.toDF("j", "nj", "other", "c"), "c").filter("i < j or i <> j and not other")
        return both.select("i", "j", (F.col("ni") * F.col("nj")).alias("k"), F.lit(x).cast("long").alias("x"), F.lit(1 - x).cast("long").alias("y"))

    crossed = met("p", 1).union(met("q", 0)).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.first("k").alias("k"))
    all_ = alike.union(unlike).union(crossed.select("x", "y", "k")).filter("x + y > 0")
    return all_.groupBy("x", "y").agg(F.sum("k").alias("k")).filter("k > 0")


def omega(a: DataFrame, b: DataFrame) -> DataFrame:
    """(omega): agreement of two covers on how many communities each pair of nodes shares, beyond chance.

    Pairs are counted, not made (shared_pairs).
    """
    n = a.select("node").union(b.select("node")).distinct().count()
    whole = n * (n - 1) / 2
    cells = written(shared_pairs(a, b), "cells")
    none = whole - F.coalesce(F.sum("k"), F.lit(0))
    same = cells.agg((F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("k"))), F.lit(0)) + none).alias("same"), none.alias("none"))
    hist = lambda c: cells.groupBy(F.col(c).alias("t")).agg(F.sum("k").alias(f"k{c}"))
    joined = hist("x").join(hist("y"), "t", "full").crossJoin(F.broadcast(same.select("none")))
    zero = F.when(F.col("t") == 0, F.col("none")).otherwise(0)
    expected = joined.agg((F.sum((F.coalesce("kx", F.lit(0)) + zero) * (F.coalesce("ky", F.lit(0)) + zero)) / whole**2).alias("e0"), F.max((F.col("t") == 0).cast("int")).alias("has0"))
    one = same.crossJoin(expected)
    e = F.coalesce("e0", F.lit(0.0)) + F.when(F.coalesce("has0", F.lit(0)) == 0, (F.col("none") / whole) ** 2).otherwise(0.0)
    o = F.col("same") / whole
    return one.select(F.when(e >= 1, 1.0).otherwise((o - e) / (1 - e)).alias("omega"))


def overlap_grouping(cover: DataFrame) -> DataFrame:
    """(memberships, nodes, extra): the sum of sizes, distinct nodes, and their difference."""
    return cover.distinct().agg(F.count("*").alias("memberships"), F.count_distinct("node").alias("nodes"), (F.count("*") - F.count_distinct("node")).alias("extra"))


# ---- statistics of graphs ----


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c by (degree, id) rank: each triangle once; wedges only from the lower-degree end."""
    deg = degrees(edges)
    e = edges.select("src", "dst").join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    low = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"), F.when(up, F.col("dd")).otherwise(F.col("ds")).alias("k"))
    wedges = low.toDF("a", "b", "kb").join(low.toDF("a", "c", "kc"), "a").filter(F.struct("kb", "b") < F.struct("kc", "c"))
    closed = low.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return wedges.join(closed, ["b", "c"], "left_semi").select("a", "b", "c")


CELL_EDGES = 12_000_000  #: edges that a task of triangle_counts holds, about
WEDGES = 1_000_000  #: wedges that it looks up at a time


def _closed(cell: tuple[int, int, int], low: np.ndarray, high: np.ndarray, colours: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, triangles) of edges low < high, from triangles whose corners have the cell's three colours."""
    def side(x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
        at = (low % colours == x) & (high % colours == y)
        a, b = low[at], high[at]
        order = np.lexsort((b, a))
        return a[order], b[order]

    for x, y, z in sorted(set(permutations(cell))):
        (a, b), (a2, c2), (b3, c3) = side(x, y), side(x, z), side(y, z)
        if not (len(a) and len(a2) and len(b3)):
            continue
        order = np.lexsort((a, b))  # looks at the third side from one node after another
        a, b, third = a[order], b[order], (b3 << 32) | c3
        begin, end = np.searchsorted((a2 << 32) | c2, (a << 32) | b, "right"), np.searchsorted(a2, a, "right")
        count = np.maximum(end - begin, 0)
        of_c, at, upto = np.zeros(len(c2), np.int64), 0, np.cumsum(count)
        while at < len(a):
            to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WEDGES, "right")), at + 1)
            n = count[at:to]
            row = np.repeat(np.arange(to - at), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:to], n)
            key = (b[at:to][row] << 32) | c2[place]
            hit = third[np.minimum(np.searchsorted(third, key), len(third) - 1)] == key
            of_row = np.bincount(row[hit], minlength=to - at)
            some = of_row > 0
            for nodes in (a[at:to], b[at:to]):
                yield nodes[some], of_row[some]
            of_c += np.bincount(place[hit], minlength=len(c2))
            at = to
        yield c2[of_c > 0], of_c[of_c > 0]


def _triangles_of(colours: int):  # noqa: ANN202
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        low, high = (table.column(c).to_numpy() for c in ("src", "dst"))
        found = list(_closed((cell // colours**2, cell // colours % colours, cell % colours), low, high, colours))
        nodes, counts = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        each, at = np.unique(nodes, return_inverse=True)
        return pa.table({"node": pa.array(each, pa.int64()), "t": pa.array(np.bincount(at, counts, len(each)).astype(np.int64))})

    return run


def triangle_counts(edges: DataFrame, cell_edges: int = CELL_EDGES) -> DataFrame:
    """(node, t): triangles of each node that is in one; edges: distinct, without loops.

    Nodes have numbers in order of degree and a colour; a task gets the edges among three colours and counts the triangles whose corners
    have just these. So an edge moves once a colour, wedges never, and the number of colours grows with the root of the edges.
    """
    m = edges.count()
    colours = 1 if m <= 200_000 else max(4, int(np.ceil(np.sqrt(6 * m / cell_edges))))
    e = numbered_edges(edges, by_degree=True)
    x, y = (F.pmod(c, F.lit(colours)) for c in ("src", "dst"))
    cell = F.array_sort(F.array(x, y, F.col("third")))
    dealt = e.withColumn("third", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(colours - 1).cast("long"))))
    dealt = dealt.select((cell[0] * colours**2 + cell[1] * colours + cell[2]).alias("cell"), "src", "dst")
    cells = colours * (colours + 1) * (colours + 2) // 6
    found = dealt.repartition(max(cells, parts(edges, 0)), "cell").groupBy("cell").applyInArrow(_triangles_of(colours), "node long, t long")
    found = written(found.groupBy("node").agg(F.sum("t").alias("t")), "triangles").toDF("id", "t")
    names = numbered(degrees(edges), "degree", "node", name="id", first=0, rows=min(2 * m, degrees(edges).count()))
    return names.join(found, "id").select("node", "t")


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, coefficient): local clustering; 0 below degree 2."""
    t = triangle_counts(edges)
    pairs = choose2(F.col("degree"))
    out = degrees(edges).join(t, "node", "left").select("node", "degree", F.coalesce("t", F.lit(0)).cast("long").alias("triangles"))
    return out.withColumn("coefficient", F.when(pairs > 0, F.col("triangles") / pairs).otherwise(0.0))


def graph_statistics(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(statistic, value): the ten recorded statistics of a graph with its true cover."""
    basic = degrees(edges).agg(F.count("*").cast("double").alias("nodes"), (F.sum("degree") / 2).alias("edges"))
    basic = basic.crossJoin(cover.agg(F.count_distinct("c").cast("double").alias("communities"))).crossJoin(overlapping(cover).agg(F.count("*").cast("double").alias("overlapping_nodes")))
    basic = basic.crossJoin(clustering(edges).agg(F.avg("coefficient").alias("average_clustering")))
    head = basic.unpivot([], basic.columns, "statistic", "value")
    wanted = ["normalized_cut", "internal_edge_density", "significance_recorded", "average_internal_degree", "modularity_density"]
    return head.union(quality(edges, cover).filter(F.col("metric").isin(wanted)))


def neighbor_degree(edges: DataFrame) -> DataFrame:
    """(degree, n, knn): mean neighbor degree by degree."""
    d = degrees(edges)
    near = both_ways(edges).join(d.toDF("neighbor", "kn"), "neighbor").groupBy("node").agg(F.avg("kn").alias("x"))
    return d.join(near, "node").groupBy("degree").agg(F.count("*").alias("n"), F.avg("x").alias("knn"))


def clustering_by_degree(edges: DataFrame) -> DataFrame:
    return clustering(edges).filter("degree > 1").groupBy("degree").agg(F.count("*").alias("n"), F.avg("coefficient").alias("coefficient"))


def path_statistics(distances: DataFrame) -> DataFrame:
    """(diameter, average, pairs) from (source, node, d)."""
    return distances.filter("d > 0").agg(F.max("d").alias("diameter"), F.avg("d").alias("average"), F.count("*").alias("pairs"))


def shells(distances: DataFrame) -> DataFrame:
    """(d, reached, cumulative): mean number of nodes at, and within, each distance of a source."""
    n = distances.select("source").distinct().count()
    at = distances.groupBy("d").agg((F.count("*") / n).alias("reached"))
    return at.withColumn("cumulative", F.sum("reached").over(Window.orderBy("d")))  # a row for each distance


def betweenness(edges: DataFrame) -> DataFrame:
    """(src, dst, betweenness): shortest paths through each link, both directions of each pair; one source after another in tasks."""
    spark = edges.sparkSession
    rows = edges.select("src", "dst").toPandas()
    shared = spark.sparkContext.broadcast(rows.to_numpy())

    def kernel(frames):  # noqa: ANN001, ANN202
        pairs = shared.value
        ids = np.unique(pairs)
        ends = np.searchsorted(ids, pairs)
        near: list[list[tuple[int, int]]] = [[] for _ in ids]
        for e, (a, b) in enumerate(ends.tolist()):
            near[a].append((b, e))
            near[b].append((a, e))
        total = np.zeros(len(pairs))
        for f in frames:
            for s in np.searchsorted(ids, f["node"]).tolist():
                dist, paths, order = {s: 0}, {s: 1.0}, [s]
                for u in order:
                    for v, _ in near[u]:
                        if v not in dist:
                            dist[v], paths[v] = dist[u] + 1, 0.0
                            order.append(v)
                        if dist[v] == dist[u] + 1:
                            paths[v] += paths[u]
                back = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u, e in near[v]:
                        if dist[u] == dist[v] - 1:
                            part = paths[u] / paths[v] * (1 + back[v])
                            back[u] += part
                            total[e] += part
        yield pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1], "betweenness": total})

    sources = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    sources = sources.repartition(max(1, min(64, len(rows) // 200)), "node")
    return sources.mapInPandas(kernel, "src long, dst long, betweenness double").groupBy("src", "dst").agg(F.sum("betweenness").alias("betweenness"))


# ---- histograms and distributions ----


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, lower, n): equal bins from low to high; high itself is in the last one, values outside are left out."""
    width = (high - low) / bins
    x = F.col(column).cast("double")
    b = F.least(F.floor((x - low) / width), F.lit(bins - 1))
    return df.filter((x >= low) & (x <= high)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n")).withColumn("lower", low + F.col("bin") * width)


def log_histogram(df: DataFrame, column: str, base: float = 2.0) -> DataFrame:
    """(bin, lower, n, density): bins from base^i to base^(i+1), the counts over width and total."""
    x = F.col(column).cast("double")
    at = df.filter(x > 0).groupBy(F.floor(F.round(F.ln(x) / np.log(base), 9)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    total = at.agg(F.sum("n").alias("t"))
    lower = F.pow(F.lit(base), F.col("bin"))
    return at.crossJoin(F.broadcast(total)).select("bin", lower.alias("lower"), "n", (F.col("n") / F.col("t") / (lower * (base - 1))).alias("density"))


def cumulative(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share): counts of each value, and the share of values at most it."""
    at = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    w = Window.orderBy("value")
    return at.withColumn("share", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()))  # a row for each value


def quantile_bands(df: DataFrame, x: str, y: str, q: float = 0.5) -> DataFrame:
    """(x, n, mean, variance, low, high): moments of y for each x, and the values at ranks round((1 -/+ q) / 2 n)."""
    by = Window.partitionBy(x).orderBy(y)
    r = df.select(F.col(x), F.col(y).cast("double").alias(y)).withColumn("r", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(Window.partitionBy(x)))
    at = lambda s: F.least(F.floor((1 + s * q) / 2 * F.col("n") + 0.5), F.col("n") - 1)
    pick = lambda s, name: F.max(F.when(F.col("r") == at(s), F.col(y))).alias(name)
    return r.groupBy(F.col(x).alias("x")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("variance"), pick(-1, "low"), pick(1, "high"))


@pandas_udf(DoubleType())
def log_factorial(n: pd.Series) -> pd.Series:
    """ln n!"""
    return n.map(lambda v: lgamma(v + 1.0))


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)
