"""The line graph, and distances between links."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.linalg import block_pairs, hops, resistance_matrix, row_pairs
from loomgraph.functions.sparse import LinkResistances, hop_rows
from loomgraph.functions.storage import written
from loomgraph.operators.graph import components, degrees, search

DENSE = 2_000  #: links of a component whose distances are made as a matrix; those of larger ones are made some rows at a time


def incidence(edges: DataFrame) -> DataFrame:
    """(node, edge_id)."""
    return edges.select("edge_id", F.explode(F.array("src", "dst")).alias("node"))


def line_graph_size(edges: DataFrame) -> int:
    """Links of the line graph of a simple graph: the sum of degree choose 2, known before it is made."""
    return int(degrees(edges).agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2)).first()[0] or 0)


def line_graph(edges: DataFrame, most: int | None = None, hub: int = 10_000) -> DataFrame:
    """(e1, e2), e1 < e2: links that share a node.

    The result grows with the squares of degrees; most stops it beforehand. Links of nodes above hub are dealt out again in
    blocks, so that no task makes all pairs of one hub.
    """
    if most is not None and line_graph_size(edges) > most:
        raise ValueError(f"the line graph has more than {most} links")
    inc = incidence(edges)
    deg = inc.groupBy("node").agg(F.ceil(F.count("*") / hub).cast("int").alias("blocks"))
    inc = inc.join(deg, "node").withColumn("block", F.pmod(F.xxhash64("edge_id"), F.col("blocks")).cast("int"))
    left = inc.select("node", F.col("edge_id").alias("e1"), "block")
    right = inc.select("node", F.col("edge_id").alias("e2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["node", "block"]).filter("e1 < e2").select("e1", "e2").distinct()


def line_links(lines: DataFrame) -> DataFrame:
    """The line graph's links in both directions, as (node, neighbor)."""
    return lines.select(F.col("e1").alias("node"), F.col("e2").alias("neighbor")).union(lines.select(F.col("e2"), F.col("e1")))


def line_degrees(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """(edge_id, degree) in the line graph; 0 for links that share no node."""
    d = line_links(lines).groupBy(F.col("node").alias("edge_id")).agg(F.count("*").alias("degree"))
    return edges.select("edge_id").join(d, "edge_id", "left").select("edge_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def _all_steps(edges: DataFrame, lines: DataFrame, most: int = DENSE) -> DataFrame:
    """(e1, e2, d) of links that reach each other: components of at most most links in a task each, greater ones in a task for some of
    their rows."""
    small, comp, large = _by_size(edges, lines, most)
    found = block_pairs(lines, small, hops, "all", most).select("e1", "e2", "d")
    if large is None:
        return found
    members = comp.select(F.col("node").alias("e1"), F.col("node").alias("e2"), "component")
    rows = lines.join(comp.withColumnRenamed("node", "e1"), "e1").select("e1", "e2", "component").union(members).join(large.select("component"), "component")

    def begin(rows: pd.DataFrame) -> tuple:
        e1, e2 = rows["e1"].to_numpy(), rows["e2"].to_numpy()
        ids = np.sort(e1[e1 == e2])
        i, j = np.searchsorted(ids, e1[e1 != e2]), np.searchsorted(ids, e2[e1 != e2])
        return ids, lambda at: hop_rows(i, j, len(ids), at), None

    return found.union(row_pairs(rows, "e1", large, begin, "all").select("e1", "e2", "d"))


def _by_size(edges: DataFrame, lines: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(node, component) of components of at most most links, of all, and (component, count) of the larger ones, None if there are none."""
    comp = written(line_components(edges, lines), "line-components")
    large = comp.groupBy("component").count().filter(F.col("count") > most)
    if not large.limit(1).count():
        return comp, comp, None
    return comp.join(large, "component", "left_anti").select("node", "component"), comp, written(large, "large")


def _measured(edges: DataFrame, lines: DataFrame, value: Callable[[np.ndarray], np.ndarray], rows: Callable[[LinkResistances, np.ndarray], np.ndarray], pairs: str, rcond: float | None) -> DataFrame:
    """(component, e1, e2, d) of a measure of resistances: from a component's matrix, or, where rcond is not given and so asks for none,
    from the links of components of more than DENSE some rows at a time."""
    if rcond is not None:
        return block_pairs(lines, line_components(edges, lines), value, pairs)
    small, comp, large = _by_size(edges, lines, DENSE)
    found = block_pairs(lines, small, value, pairs)
    if large is None:
        return found
    links = edges.select("edge_id", "src", "dst").join(comp.toDF("edge_id", "component"), "edge_id").join(large.select("component"), "component")

    def begin(links: pd.DataFrame) -> tuple:
        of = LinkResistances(links["src"].to_numpy(), links["dst"].to_numpy())
        return links["edge_id"].to_numpy(), lambda at: rows(of, at), of.adjacency

    return found.union(row_pairs(links, "edge_id", large, begin, pairs))


def shortest_paths(edges: DataFrame, lines: DataFrame, unreachable: str = "zero", sources: DataFrame | None = None) -> DataFrame:
    """(e1, e2, d) for all ordered pairs of links (or from sources (edge_id)): hops in the line graph.

    Unreachable pairs have 0, or null with unreachable="null", or are left out with "drop".
    """
    starts = (edges if sources is None else sources).select(F.col("edge_id").alias("node"))
    found = _all_steps(edges, lines) if sources is None else search(line_links(lines), starts).select(F.col("source").alias("e1"), F.col("node").alias("e2"), F.col("d").cast("double").alias("d"))
    if unreachable == "drop":
        return found
    pairs = starts.select(F.col("node").alias("e1")).crossJoin(edges.select(F.col("edge_id").alias("e2")))  # the result's own size
    out = pairs.join(found, ["e1", "e2"], "left")
    return out.fillna(0.0, ["d"]) if unreachable == "zero" else out


def generalised_degree(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """(e1, e2, d), e1 < e2: the sum over k of k g1(k) g2(k) / m(k)^2.

    g(k): shortest walks of length k from a link to links at distance k; m(k): their sum over all links. Pairs whose sum is 0 have 0.
    """
    walks = search(line_links(lines), edges.select(F.col("edge_id").alias("node")), counted=True).filter("d > 0")
    g = written(walks.groupBy(F.col("source").alias("e"), F.col("d").alias("k")).agg(F.sum("walks").cast("double").alias("g")), "walks")
    share = g.join(F.broadcast(g.groupBy("k").agg(F.sum("g").alias("m"))), "k").select("e", "k", (F.col("g") / F.col("m")).alias("s"))
    a, b = share.toDF("e1", "k", "s1"), share.toDF("e2", "k", "s2")
    summed = a.join(b, "k").filter("e1 < e2").groupBy("e1", "e2").agg(F.sum(F.col("k") * F.col("s1") * F.col("s2")).alias("d"))
    ids = edges.select("edge_id")
    pairs = ids.toDF("e1").join(ids.toDF("e2"), F.col("e1") < F.col("e2"))
    return pairs.join(summed, ["e1", "e2"], "left").fillna(0.0, ["d"])


def line_components(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, component): links and the smallest link they reach in the line graph."""
    return components(lines.toDF("src", "dst"), edges.select(F.col("edge_id").alias("node")))


def resistances(edges: DataFrame, lines: DataFrame, method: str = "svd", rcond: float | None = None, pairs: str = "upper") -> DataFrame:
    """(e1, e2, r, component), e1 < e2 in one component: effective resistance in the line graph; pairs="linked": of adjacent links only.

    method and rcond are those of matrices; components of more than DENSE links are eliminated node by node, whatever the method, unless
    rcond is given.
    """
    found = _measured(edges, lines, lambda a: resistance_matrix(a, method, rcond), lambda of, at: of.rows(at), pairs, rcond)
    return found.select("e1", "e2", F.col("d").alias("r"), "component")


def commute_matrix(adjacent: np.ndarray, volume: float, squared: bool = False, method: str = "svd", rcond: float | None = None) -> np.ndarray:
    d2 = np.maximum(volume * resistance_matrix(adjacent, method, rcond), 0.0)
    return d2 if squared else np.sqrt(d2)


def commute_rows(of: LinkResistances, at: np.ndarray, volume: float, squared: bool = False) -> np.ndarray:
    d2 = np.maximum(volume * of.rows(at), 0.0)
    return d2 if squared else np.sqrt(d2)


def commute(edges: DataFrame, lines: DataFrame, squared: bool = False, method: str = "svd", rcond: float | None = None) -> DataFrame:
    """(e1, e2, d), e1 < e2 in one component: the root of volume times resistance; squared: without the root."""
    volume = 2.0 * lines.count()
    return _measured(edges, lines, lambda a: commute_matrix(a, volume, squared, method, rcond), lambda of, at: commute_rows(of, at, volume, squared), "upper", rcond).select("e1", "e2", "d")


def amplified_matrix(adjacent: np.ndarray, squared: bool = False, method: str = "svd", rcond: float | None = None, link_term: str = "adjacent") -> np.ndarray:
    k = adjacent.sum(1).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        inverse = 1 / k
        a = adjacent.astype(float) if link_term == "adjacent" else np.ones(adjacent.shape)
        d2 = resistance_matrix(adjacent, method, rcond) - inverse[:, None] - inverse[None, :] + 2 * a / (k[:, None] * k[None, :])
        d2 = np.where(np.abs(d2) <= 1e-12, 0.0, np.where(d2 > 0, d2, np.nan))
    return d2 if squared else np.sqrt(d2)


def amplified_rows(of: LinkResistances, at: np.ndarray, squared: bool = False, link_term: str = "adjacent") -> np.ndarray:
    inverse = 1 / of.degrees
    d2 = of.rows(at) - inverse[at][:, None] - inverse
    if link_term == "adjacent":
        for i, x in enumerate(at.tolist()):
            near = of.adjacent(x)
            d2[i, near] += 2 * inverse[x] * inverse[near]
    else:
        d2 += 2 * inverse[at][:, None] * inverse
    d2[np.arange(len(at)), at] = 0.0
    d2 = np.where(np.abs(d2) <= 1e-12, 0.0, np.where(d2 > 0, d2, np.nan))
    return d2 if squared else np.sqrt(d2)


def amplified_commute(edges: DataFrame, lines: DataFrame, squared: bool = False, method: str = "svd", rcond: float | None = None, link_term: str = "adjacent") -> DataFrame:
    """(e1, e2, d), e1 < e2 in one component: root of R - 1/k1 - 1/k2 + 2 a / (k1 k2); link_term="always" takes a as 1.

    Values within 1e-12 of 0 count as 0; lower ones have null.
    """
    return _measured(edges, lines, lambda a: amplified_matrix(a, squared, method, rcond, link_term), lambda of, at: amplified_rows(of, at, squared, link_term), "upper", rcond).select("e1", "e2", "d")


def block_measure(distance: Callable[[DataFrame, DataFrame], DataFrame], lines: DataFrame) -> Callable[[np.ndarray], np.ndarray] | None:
    """The dense measure of a component for a distance that needs no more than the component; None for others."""
    if distance is commute:
        volume = 2.0 * lines.count()
        return lambda a: commute_matrix(a, volume)
    return amplified_matrix if distance is amplified_commute else None


def row_measure(distance: Callable[[DataFrame, DataFrame], DataFrame], lines: DataFrame) -> Callable[[LinkResistances, np.ndarray], np.ndarray] | None:
    """As block_measure, for some rows of a component that is too large for a matrix."""
    if distance is commute:
        volume = 2.0 * lines.count()
        return lambda of, at: commute_rows(of, at, volume)
    return amplified_rows if distance is amplified_commute else None


def distance(name: str, edges: DataFrame, lines: DataFrame) -> DataFrame:
    """(e1, e2, d), e1 < e2, of a registered distance."""
    from loomgraph.registry import DISTANCES

    return DISTANCES[name](edges, lines)
