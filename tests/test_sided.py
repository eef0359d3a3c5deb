"""Directed and weighted clean-up, and the core method by component."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cleanup, graph, linegraph, medoids, sided
from loomgraph.plans import known, partition
from loomgraph.registry import METHODS


def two_rings(n=8, seed=0):
    """Two groups whose nodes link to all of their group, and a few links between them."""
    r, links = np.random.default_rng(seed), []
    for base in (0, n):
        links += [(base + i, base + j, 1.0 + r.random()) for i in range(n) for j in range(n) if i != j and r.random() < 0.8]
    links += [(int(i), int(n + i), 1.0) for i in range(2)]
    far = [(100 + i, 100 + (i + 1) % 60, 1.0) for i in range(60)]  # a ring without groups
    return links + far + [(0, 100, 1.0), (n, 130, 1.0)]


def by_hand(links, core, node, weighted):
    """A node's directed score from sums over hypergeometric masses and the gamma tail."""
    out = {(a, b): w for a, b, w in links}
    m, score = len(out), 1.0
    mass = lambda x, k, free, total: math.comb(free, x) * math.comb(total - free, k - x) / math.comb(total, k)
    both = lambda a, b: a * b * (1 - math.log(a * b))
    inner = sum(a in core and b in core for a, b in out)
    sides = []
    for s in (0, 1):
        mine = [w for e, w in out.items() if e[s] == node]
        to = [w for e, w in out.items() if e[s] == node and e[1 - s] in core]
        free = sum(e[1 - s] in core for e in out) - inner
        total = m - sum(e[s] in core for e in out)
        x, k = len(to), len(mine)
        score = sum(mass(i, k, free, total) for i in range(x + 1, min(k, free) + 1)) + 0.5 * mass(x, k, free, total)
        if weighted:
            w = sum(to) / (sum(mine) / len(mine)) if to else 0.0
            score = both(score, sum(math.exp(-w) * w**i / math.factorial(i) for i in range(x)) if x else 1.0)
        sides.append(score)
    return both(*sides)


@pytest.mark.parametrize("weighted", [False, True])
def test_scores_by_hand(spark, weighted):
    links, core = two_rings(), set(range(6))
    model = sided.Sided(spark.createDataFrame(links, "src long, dst long, weight double"), True, weighted)
    table = spark.createDataFrame([(0, 1, v) for v in core], "g long, c long, node long")
    got = {r["node"]: r["score"] for r in sided.border_scores(model, table).collect()}
    near = {v for a, b, _ in links for v, u in ((a, b), (b, a)) if u in core} - core
    assert set(got) == near
    for v, s in got.items():
        assert s == pytest.approx(by_hand(links, core, v, weighted), rel=1e-9)


def test_one_side_is_the_network(spark):
    """Undirected and without weights the model gives the rows of the clean-up by counts."""
    e = spark.createDataFrame(known.links(known.KARATE), "src long, dst long")
    core = spark.createDataFrame([(0, 1, v) for v in (0, 1, 2, 3, 7, 13, 33)] + [(0, 2, v) for v in (4, 5, 6, 10, 16, 20)], "g long, c long, node long")
    rows = lambda df: sorted((r["c"], r["node"], round(r["s"], 9)) for r in df.collect())
    counts = cleanup.border_scores(cleanup.of_edges(e), core).select("c", "node", (F.col("tail") + 0.5 * F.col("now")).alias("s"))
    one = sided.border_scores(sided.Sided(e, directed=False), core).select("c", "node", F.col("score").alias("s"))
    assert rows(counts) == rows(one)


@pytest.mark.parametrize(("directed", "weighted"), [(True, True), (False, True)])
def test_groups_are_found(spark, directed, weighted):
    edges = spark.createDataFrame(two_rings(), "src long, dst long, weight double")
    found = {}
    for r in sided.significant(edges, directed, weighted, mode="check", runs=5).collect():
        found.setdefault(r["c"], set()).add(r["node"])
    for group in (set(range(8)), set(range(8, 16))):
        assert max(len(group & m) / len(group | m) for m in found.values()) >= 0.75
    assert sided.significant(edges.limit(0), directed, weighted).count() == 0


def test_components_around_their_medoids(spark):
    """Every component has the optimum of its own links, of all pairs of medoids; a single link is its own cluster."""
    links = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5), (10, 11), (11, 12), (12, 10), (12, 13), (13, 14), (20, 21), (30, 31), (31, 32)]
    e = graph.with_ids(spark.createDataFrame(links, "src long, dst long"))
    d = linegraph.amplified_commute(e, linegraph.line_graph(e)).toPandas()
    dist = {(a, b): x for a, b, x in d.itertuples(index=False)} | {(b, a): x for a, b, x in d.itertuples(index=False)}
    for algorithm in ("pmp", "pam", "kmd"):
        run = partition.component_partition(e, 2, "acm", algorithm)
        rows = run.clusters.toPandas()
        assert len(rows) == len(links)
        for _, part in rows.groupby("component"):
            ids = part["edge_id"].tolist()
            costs = [sum(min(0.0 if i == m else dist[i, m] for m in pair) for i in ids) for pair in itertools.combinations(ids, min(2, len(ids)))]
            assert part["cost"].iloc[0] == pytest.approx(min(costs), abs=1e-9)
            assert set(part["cluster_id"]) <= set(ids) and (part["gap"].eq(0).all() if algorithm == "pmp" else part["gap"].isna().all())
    with pytest.raises(ValueError, match="more than 3 links"):
        medoids.cluster_components(e, spark.createDataFrame(d), 2, most=3)
    assert METHODS["link_partition"](e.select("src", "dst"), k=2, components=True).select("c").distinct().count() == 7


def test_search_stops_by_nodes():
    d = np.abs(np.subtract.outer(*[np.random.default_rng(1).random(60)] * 2))
    found, value, gap = medoids.exact(d, 6, nodes=1)
    assert len(found) == 6 and gap >= 0 and value == pytest.approx(medoids.cost(d, found))
    assert medoids.exact(d, 6, nodes=1)[0] == found
