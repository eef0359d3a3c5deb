"""Components too large for a matrix give the rows that matrices give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import linalg, sparse
from loomgraph.operators import graph, linegraph, medoids
from loomgraph.plans import partition
from loomgraph.registry import DISTANCES


def tangle(n, m, seed=0):  # noqa: ANN001, ANN201
    """Links of a random graph, made one component by a path."""
    r = np.random.default_rng(seed)
    pairs = np.sort(np.concatenate([r.integers(0, n, (m, 2)), np.stack([np.arange(n - 1), np.arange(1, n)], 1)[:: 1]]), 1)
    return np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0)


def tangles(spark):  # noqa: ANN001, ANN201
    rows = [tuple(map(int, x)) for x in tangle(40, 30)] + [(100, 101), (101, 102), (102, 100)]
    return graph.with_ids(spark.createDataFrame(rows, "src long, dst long"))


def adjacent(pairs):  # noqa: ANN001, ANN201
    a = (pairs[:, None, :, None] == pairs[None, :, None, :]).any((2, 3))
    np.fill_diagonal(a, False)
    return a


@pytest.mark.parametrize("front", [1, 3, 64])
def test_resistances_by_elimination(front):  # noqa: ANN001
    for pairs in (tangle(60, 50), tangle(30, 200), np.array([(0, 1), (1, 2)]), np.array([(5, i) for i in (1, 2, 3, 9)])):
        of, a = sparse.LinkResistances(pairs[:, 0], pairs[:, 1], front), adjacent(pairs)
        every = np.arange(len(pairs))
        assert np.allclose(of.rows(every), linalg.resistance_matrix(a), rtol=0, atol=1e-11)
        assert (of.adjacency(every) == a).all() and np.allclose(of.degrees, a.sum(1))
        i, j = np.nonzero(np.triu(a))
        assert (sparse.hop_rows(i, j, len(a), every[1:]) == linalg.hops(a)[1:]).all()


def test_distances_of_large_components(spark, monkeypatch):  # noqa: ANN001
    e = tangles(spark)
    lines = linegraph.line_graph(e)
    ways = {
        "commute": lambda: linegraph.commute(e, lines), "amplified": lambda: linegraph.amplified_commute(e, lines),
        "linked": lambda: linegraph.resistances(e, lines, pairs="linked"), "steps": lambda: linegraph._all_steps(e, lines, linegraph.DENSE),
    }
    rows = lambda f: {(r["e1"], r["e2"]): r[2] for r in f().collect()}
    want = {k: rows(f) for k, f in ways.items()}
    monkeypatch.setattr(linegraph, "DENSE", 10)
    monkeypatch.setattr(linalg.row_pairs, "__defaults__", ("upper", 7))  # many tasks a component
    for k, f in ways.items():
        got = rows(f)
        assert got.keys() == want[k].keys() and len(got) == len(want[k]) > 60
        assert all(abs(got[x] - want[k][x]) < 1e-9 for x in got)


@pytest.mark.parametrize(("distance", "algorithm", "k"), [("acm", "pmp", 2), ("acm", "pam", 3), ("cm", "kmd", 3), ("acm", "pmp", 3)])
def test_clusters_of_large_components(spark, distance, algorithm, k):  # noqa: ANN001
    e = tangles(spark)
    lines = linegraph.line_graph(e)
    way = DISTANCES[distance]
    measure, by_rows = linegraph.block_measure(way, lines), linegraph.row_measure(way, lines)
    rows = lambda t: sorted((r["edge_id"], r["cluster_id"], r["component"], round(r["cost"], 6), r["gap"]) for r in t.collect())
    got, want = (rows(medoids.cluster_blocks(e, lines, measure, k, algorithm, most=most, rows=by_rows)) for most in (10, 1000))
    if (k, algorithm) == (3, "pmp"):  # the gap is told, not closed
        assert all(a[3] >= b[3] - 1e-6 and a[3] * (1 - a[4]) <= b[3] + 1e-6 for a, b in zip(got, want, strict=True))
    else:
        assert got == want


def test_pairs_left_by_the_bound(monkeypatch):  # noqa: ANN001
    from loomgraph.operators import medoid_rows

    r = np.random.default_rng(1)
    for cells in (40, 400, 1 << 20):
        monkeypatch.setattr(sparse, "CELLS", cells)
        monkeypatch.setattr(medoid_rows, "CELLS", cells)
        x = r.integers(0, 6, (45, 2)).astype(float)  # many equal distances
        d = medoids.rounded(np.hypot(*(x[:, None] - x[None]).transpose(2, 0, 1)))
        want = medoids.exact(d, 2)
        for passes in (1, 12):
            assert medoid_rows.exact(lambda at: d[at], 45, 2, passes) == want  # noqa: B023


def test_refused_only_where_no_rows_are_known(spark):  # noqa: ANN001
    e = tangles(spark)
    lines = linegraph.line_graph(e)
    with pytest.raises(ValueError, match="more than 10"):
        medoids.cluster_blocks(e, lines, linegraph.block_measure(linegraph.commute, lines), 2, most=10)
    assert partition.component_partition(e, 2, "acm", most=10).clusters.agg(F.max("gap")).first()[0] == 0.0


def test_a_loop_of_sketches_keeps_no_round(spark, monkeypatch):  # noqa: ANN001
    from loomgraph.functions import storage
    from loomgraph.operators import paths

    monkeypatch.setattr(paths, "EXACT", 1)
    e = spark.createDataFrame([(i, (i + 1) % 60) for i in range(60)], "src long, dst long")
    before = len(storage._written)
    got = {r["d"]: r["within"] for r in paths.neighborhood_function(e, rounds=4, registers=14, exact=200).collect()}
    kept = [x[1] for x in storage._written[before:]]
    assert all(abs(got[d] - 60 * (2 * d + 1)) < 0.02 * got[d] for d in range(5))
    assert kept and not [x for x in kept if any(name in x for name in ("sketches", "listeners", "balls", "ball-sizes"))]


def test_demon_takes_the_whole_graph(spark, monkeypatch):  # noqa: ANN001
    from loomgraph.operators import egos
    from loomgraph.plans import community_queries, derived, queries  # noqa: F401 - the former registers demon

    asked = []
    monkeypatch.setattr(egos, "demon", lambda edges: asked.append(edges.count()))
    queries.QUERIES["demon"](spark, "/root/testdata/sf0.001")
    assert asked == [derived.co_part(spark, "/root/testdata/sf0.001", 1).count()]


def test_containment_of_pairs_that_share_little(spark):  # noqa: ANN001
    from loomgraph.operators import egos

    r = np.random.default_rng(2)
    sets = [set(r.choice(80, n, replace=False).tolist()) for n in r.integers(10, 60, 40)]
    sets += [set(list(s)[: -(-3 * len(s) // 4)]) | {100 + i} for i, s in enumerate(sets[:10])]
    t = spark.createDataFrame([(i, int(v)) for i, m in enumerate(sets) for v in m], "c long, node long")
    for share in (0.2, 0.7):
        want = {(i, j, len(a & b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and (len(a), -i) < (len(b), -j) and len(a & b) >= share * len(a) - 1e-9}
        assert {tuple(x)[:3] for x in egos.contained(t, share).collect()} == want and want


def test_eagle_takes_the_whole_graph(spark, monkeypatch):  # noqa: ANN001
    from loomgraph.operators import kernels
    from loomgraph.plans import derived, queries

    asked = []
    monkeypatch.setattr(kernels, "eagle", lambda edges, k: asked.append((edges.count(), k)))
    queries.QUERIES["eagle"](spark, "/root/testdata/sf0.001")
    assert asked == [(derived.co_part(spark, "/root/testdata/sf0.001", 1).count(), 3)]


def test_agglomeration_as_over_a_table_of_pairs():
    from loomgraph.operators import kernels

    for seed in range(6):
        pairs = tangle(24, 40, seed)
        n, m = 24, len(pairs)
        a = np.zeros((n, n))
        a[pairs[:, 0], pairs[:, 1]] = a[pairs[:, 1], pairs[:, 0]] = 1
        near = {i: set(np.flatnonzero(a[i]).tolist()) for i in range(n)}
        groups = sorted({tuple(sorted(c)) for x in range(n) for c in kernels.maximal_cliques(near, x, 3)})
        covered = {x for g in groups for x in g}
        groups = [np.array(g) for g in groups] + [np.array([x]) for x in range(n) if x not in covered]
        k = a.sum(1)
        b = 2 * m * a - np.outer(k, k)
        np.fill_diagonal(b, 0)
        s = np.array([np.isin(np.arange(n), g) for g in groups], float)
        eq = lambda s: sum(r @ a @ r - (r @ k) ** 2 / (2 * m) for r in s / s.sum(0)) / (2 * m)  # noqa: B023, E731
        best, want = eq(s), s
        while len(s) > 1:
            sim = s @ b @ s.T
            np.fill_diagonal(sim, -np.inf)
            i, j = sorted(divmod(int(sim.argmax()), len(s)))
            s = np.vstack([np.delete(s, (i, j), 0), np.maximum(s[i], s[j])])
            if eq(s) > best + 1e-12:
                best, want = eq(s), s
        assert [np.flatnonzero(r).tolist() for r in want] == [g.tolist() for g in kernels.agglomerated(pairs[:, 0], pairs[:, 1], groups)]
