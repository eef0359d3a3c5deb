"""Hand-checked graphs, properties and differential checks of the graph operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.linalg import laplacian_inverse, pseudo_inverse
from loomgraph.operators import cover, detect, generate, graph, kernels, linegraph, medoids, membership, metrics, significance
from loomgraph.plans import experiment, partition, predict

TRIANGLES = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]
BOWTIE = [(0, 1), (0, 2), (1, 2), (2, 3), (2, 4), (3, 4)]
PATH = [(1, 2), (2, 3), (3, 4)]
STAR = [(0, 1), (0, 2), (0, 3)]


def edges(spark, pairs):
    return graph.with_ids(spark.createDataFrame(pairs, "src long, dst long"))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_canonical_policies(spark):
    e = spark.createDataFrame([(2, 1, 3.0), (1, 2, 1.0), (5, 5, 1.0), (1, 2, 1.0)], "src long, dst long, weight double")
    assert rows(graph.canonical(e)) == [(1, 2, 1, 1.0)]
    assert rows(graph.canonical(e, "sum", "keep")) == [(1, 2, 3, 5.0), (5, 5, 1, 1.0)]
    assert rows(graph.canonical(e, "first")) == [(1, 2, 1, 1.0)]
    assert graph.canonical(e, "keep").count() == 3


def test_ids_and_relabelling(spark):
    e = edges(spark, [(9, 7), (7, 9), (3, 7)])
    assert rows(e) == [(1, 3, 7), (2, 7, 9)]
    assert rows(graph.relabelled(e)) == [(0, 1, 3, 7), (1, 2, 7, 9)]


def test_components_and_giant(spark):
    assert rows(graph.components(edges(spark, TRIANGLES))) == [(v, 0 if v < 3 else 3) for v in range(6)]
    chain = [(i, i + 1) for i in range(40)]
    assert {r[1] for r in rows(graph.components(edges(spark, chain)))} == {0}
    empty = spark.createDataFrame([], "src long, dst long")
    assert graph.components(empty).count() == 0
    assert rows(graph.giant(edges(spark, PATH + [(8, 9)])).select("src", "dst")) == PATH


def test_line_graphs(spark):
    assert linegraph.line_graph(edges(spark, BOWTIE)).count() == 10
    assert rows(linegraph.line_graph(edges(spark, STAR))) == [(1, 2), (1, 3), (2, 3)]
    assert linegraph.line_graph(edges(spark, STAR), hub=1).count() == 3
    assert linegraph.line_graph_size(edges(spark, BOWTIE)) == 10
    with pytest.raises(ValueError, match="more than 2"):
        linegraph.line_graph(edges(spark, STAR), most=2)


def test_shortest_paths(spark):
    e = edges(spark, PATH)
    lines = linegraph.line_graph(e)
    d = {(a, b): x for a, b, x in rows(linegraph.shortest_paths(e, lines))}
    assert (d[1, 2], d[2, 3], d[1, 3], d[1, 1]) == (1, 1, 2, 0)
    e = edges(spark, TRIANGLES)
    far = {(a, b): x for a, b, x in rows(linegraph.shortest_paths(e, linegraph.line_graph(e), "null"))}
    assert far[1, 4] is None
    assert all(x == 0 for a, b, x in rows(linegraph.shortest_paths(e, linegraph.line_graph(e))) if (a <= 3) != (b <= 3))


def test_generalised_degree(spark):
    e = edges(spark, PATH)
    d = {(a, b): x for a, b, x in rows(linegraph.generalised_degree(e, linegraph.line_graph(e)))}
    assert d[1, 2] == pytest.approx(0.125)
    assert d[1, 3] == pytest.approx(0.5625)


def test_commute_distances(spark):
    e = edges(spark, PATH)
    lines = linegraph.line_graph(e)
    assert {(a, b): x for a, b, x in rows(linegraph.commute(e, lines, squared=True))}[1, 3] == pytest.approx(8)
    e = edges(spark, STAR)
    lines = linegraph.line_graph(e)
    assert all(x == pytest.approx(2) for _, _, x in rows(linegraph.commute(e, lines)))
    for method in ("svd", "gamma"):
        got = rows(linegraph.amplified_commute(e, lines, method=method))
        assert all(x == pytest.approx(math.sqrt(2 / 3 - 1 / 2 - 1 / 2 + 2 / 4)) for _, _, x in got)


def test_pseudo_inverse_properties():
    r = np.random.default_rng(0)
    a = r.normal(size=(6, 4)) @ r.normal(size=(4, 6))
    p = pseudo_inverse(a)
    assert np.allclose(a @ p @ a, a) and np.allclose(p @ a @ p, p)
    assert pseudo_inverse(np.zeros((3, 3))) is None
    i, j = np.array([0, 1, 2]), np.array([1, 2, 3])
    assert np.allclose(laplacian_inverse(4, i, j), laplacian_inverse(4, i, j, "gamma"))
    assert np.allclose(laplacian_inverse(4, i, j).sum(0), 0)


def test_membership_and_threshold(spark):
    e = edges(spark, BOWTIE)
    clusters = e.select("edge_id", F.when(F.col("edge_id") <= 3, 1).otherwise(4).cast("long").alias("cluster_id"))
    m = membership.membership(e, clusters)
    shares = {(n, c): b for n, c, _, b in rows(m)}
    assert shares[2, 1] == shares[2, 2] == 0.5
    assert rows(membership.threshold(m, 0.5)) == [(1, 0), (1, 1), (1, 2), (2, 2), (2, 3), (2, 4)]
    assert 2 not in {n for _, n in rows(membership.threshold(m, 0.51))}
    links, nodes = membership.colours(e, clusters)
    assert links.count() == 6 and nodes.count() == 5


def test_exact_median_is_optimal():
    r = np.random.default_rng(1)
    for n, p in ((9, 3), (30, 4), (34, 5)):
        x = r.normal(size=(n, 2))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        found, value, gap = medoids.exact(d, p, 60)
        assert gap == 0 and value == pytest.approx(medoids.cost(d, found))
        if math.comb(n, p) < 400_000:
            best = min(medoids.cost(d, m) for m in itertools.combinations(range(n), p))
            assert value == pytest.approx(best)
        assert value <= medoids.cost(d, medoids.pam(d, p, 0)) + 1e-9
        assert value <= medoids.clarans(d, p, 0)[1] + 1e-9


def test_polynomial_gives_costs(spark):
    r = np.random.default_rng(2)
    x = r.integers(0, 50, (7, 2))
    d = np.abs(x[:, None] - x[None]).sum(2).astype(float)
    table = spark.createDataFrame([(i + 1, j + 1, float(d[i, j])) for i in range(7) for j in range(7)], "e1 long, e2 long, d double")
    terms = [(set(v), c) for v, c in medoids.polynomial(table, 3).collect()]
    for chosen in itertools.combinations(range(1, 8), 3):
        closed = set(range(1, 8)) - set(chosen)
        value = sum(c for v, c in terms if v <= closed)
        assert value == pytest.approx(medoids.cost(d, [c - 1 for c in chosen]))


@pytest.mark.parametrize(("distance", "algorithm"), [("acm", "pmp"), ("cm", "kmd"), ("sp", "pam"), ("gd", "kmn")])
def test_link_partition(spark, distance, algorithm):
    run = partition.link_partition(spark.createDataFrame(BOWTIE, "src long, dst long"), 2, distance, algorithm, 0.0)
    assert rows(run.clusters.groupBy("edge_id").count())[0][1] == 1 and run.clusters.count() == 6
    sums = run.members.groupBy("node").agg(F.sum("belonging").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)
    if distance == "acm":  # four pairs of medoids cost the same, so the cover hangs on the choice among them
        assert {n for _, n in rows(run.cover)} == set(range(5))
        full = medoids.symmetric(run.edges, linegraph.amplified_commute(run.edges, run.lines))
        ids, d = medoids.matrix(full)
        chosen = sorted({r["cluster_id"] for r in run.clusters.collect()})
        assert medoids.cost(d, np.searchsorted(ids, chosen)) == pytest.approx(0.9486832980505)
        assert medoids.cost(d, medoids.exact(d, 2)[0]) == pytest.approx(0.9486832980505) and medoids.exact(d, 2)[2] == 0


def test_ties_do_not_hang_on_rounding(spark):
    """Distances that differ by rounding alone are ties: the smaller rank gets the link, the first set is the medoids."""
    noise = 1e-15
    dist = spark.createDataFrame([(9, 1, 0.3 + noise), (9, 2, 0.3), (1, 1, 0.0), (2, 2, 0.0), (1, 2, 0.5), (2, 1, 0.5)], "e1 long, e2 long, d double")
    got = medoids.assign(dist, spark.createDataFrame([(1, 0), (2, 1)], "edge_id long, rank int"))
    assert rows(got) == [(1, 1), (2, 2), (9, 1)]
    d = np.array([[0, 1 + noise, 1], [1 + noise, 0, 1 - noise], [1, 1 - noise, 0]])
    assert medoids.exact(d, 1)[0] == [0]


def cov(spark, *communities):
    return spark.createDataFrame([(c, v) for c, m in enumerate(communities) for v in m], "c long, node long")


def test_covers(spark):
    a = cov(spark, [0, 1, 2], [2, 3, 4])
    everyone = spark.createDataFrame([(i,) for i in range(6)], "node long")
    assert rows(cover.complete(a, everyone)) == [(0, 0), (0, 1), (1, 2), (1, 3), (1, 4), (2, 5)]
    assert rows(cover.complete(a, everyone, "last"))[-1] == (1, 5)
    assert rows(cover.overlaps(a)) == [(0, 1, 1, 3, 3, 0.2)]
    assert rows(cover.homeless(cov(spark, [0, 1], [2]), everyone)) == [(2,), (3,), (4,), (5,)]
    big = cov(spark, [0, 1, 2, 3], [0, 1], [2, 3, 4], [7, 8])
    kept = cover.suppress(big, spark.createDataFrame([(i, 0.0) for i in range(4)], "c long, score double"), 0.6)
    assert {c for c, _ in rows(kept)} == {0, 3}
    assert rows(cover.pooled(a, a)) == rows(a)
    assert rows(cover.translate(cov(spark, [0, 1]), a)) == [(0, i) for i in range(5)]
    assert rows(cover.split_components(edges(spark, PATH), cov(spark, [1, 2, 4]))) == [(0, 1, 1), (0, 1, 2), (0, 4, 4)]


def test_module_network_rounds_half_up(spark):
    e = edges(spark, [(i, 100 + i) for i in range(49)]).withColumn("mult", F.lit(1))
    c = spark.createDataFrame([(0, i) for i in range(49)] + [(1, 100 + i) for i in range(49)] + [(2, 100 + i) for i in range(49)], "c long, node long")
    assert (0, 1, 25) in rows(cover.module_network(e, c))


def test_similarity_of_equal_covers(spark):
    a = cov(spark, [0, 1, 2], [2, 3, 4], [5, 6])
    assert metrics.onmi_lfk(a, a).first()[0] == pytest.approx(1)
    assert metrics.onmi_max(a, a).first()[0] == pytest.approx(1)
    assert metrics.omega(a, a).first()[0] == pytest.approx(1)
    assert metrics.f1_scores(a, a).first()[0] == pytest.approx(1)
    p = cov(spark, [0, 1], [2, 3])
    assert metrics.nmi(p, p).first()[0] == pytest.approx(1)
    assert metrics.nmi(cov(spark, [0, 1]), cov(spark, [0, 1])).first()[0] == -2
    swapped = a.select((3 - F.col("c")).alias("c"), (10 - F.col("node")).alias("node"))
    assert metrics.omega(swapped, swapped).first()[0] == pytest.approx(1)


def test_quality(spark):
    e = edges(spark, TRIANGLES + [(2, 3)])
    c = cov(spark, [0, 1, 2], [3, 4, 5])
    assert metrics.modularity(e, c).first()[0] == pytest.approx(2 * (6 / 14 - 0.25))
    assert metrics.extended_modularity(e, c).first()[0] == pytest.approx(metrics.modularity(e, c).first()[0])
    assert metrics.modularity(e, c, 0.5).first()[0] == pytest.approx(0.5 + 2 * (3 / 14 - 0.25))
    s = metrics.community_scores(e, c).filter("c = 0").first()
    assert (s["edges_inside"], s["size"], s["true_density"], s["internal_edge_density"]) == (3, 3, 1, 0.25)
    assert s["normalized_cut"] == pytest.approx(1 / 7 + 1 / 9) and s["conductance"] == pytest.approx(1 / 7)
    assert metrics.graph_statistics(e, c).count() == 10
    assert metrics.pair_similarity(e, c).first()["similarity"] == pytest.approx((1 - 49 / 14) / 14)


def test_statistics(spark):
    e = edges(spark, BOWTIE)
    assert rows(metrics.triangles(e)) == [(0, 1, 2), (3, 4, 2)]
    got = {r["node"]: r["coefficient"] for r in metrics.clustering(e).collect()}
    assert got[0] == 1 and got[2] == pytest.approx(1 / 3)
    assert all(b == 2 for b in (r["betweenness"] for r in metrics.betweenness(edges(spark, [(1, 2)])).collect()))
    b = {(r[0], r[1]): r[2] for r in rows(metrics.betweenness(edges(spark, PATH)))}
    assert b[2, 3] == 8 and b[1, 2] == 6
    d = graph.search(graph.both_ways(edges(spark, PATH)), graph.nodes(edges(spark, PATH)))
    assert rows(metrics.path_statistics(d))[0][0] == 3
    n = spark.createDataFrame([(5, 2)], "n int, k int").select(metrics.log_choose(F.col("n"), F.col("k"))).first()[0]
    assert math.exp(n) == pytest.approx(10)


def test_pagerank_keeps_mass(spark):
    r = {n: v for n, v in rows(graph.pagerank(spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double")))}
    assert sum(r.values()) == pytest.approx(1) and r[2] > r[1]


@pytest.mark.parametrize("method", ["louvain", "infomap", "label_propagation"])
def test_detectors_find_two_groups(spark, method):
    make = [(a, b) for g in (0, 10) for a in range(g, g + 6) for b in range(a + 1, g + 6)] + [(0, 10)]
    e = edges(spark, make)
    found = {"louvain": kernels.louvain, "infomap": kernels.infomap_partition, "label_propagation": detect.label_propagation}[method](e)
    groups = {}
    for c, n in rows(found.select("c", "node")):
        groups.setdefault(c, set()).add(n)
    assert sorted(map(sorted, groups.values())) == [list(range(6)), list(range(10, 16))]


def test_significant_modules():
    make = [(a, b) for g in range(0, 80, 10) for a in range(g, g + 10) for b in range(a + 1, g + 10)] + [(g, (g + 10) % 80) for g in range(0, 80, 10)]
    near = {}
    for a, b in make:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1.0
    assert sorted(m for m, _ in significance.modules_of(near, runs=2)) == [list(range(g, g + 10)) for g in range(0, 80, 10)]
    r = np.random.default_rng(0)
    noise = {}
    for a, b in {tuple(sorted(r.choice(60, 2, replace=False).tolist())) for _ in range(150)}:
        noise.setdefault(a, {})[b] = noise.setdefault(b, {})[a] = 1.0
    assert sum(len(m) for m, _ in significance.modules_of(noise, runs=2)) < 20


def test_cliques_and_expansion(spark):
    make = [(a, b) for g in (0, 4) for a in range(g, g + 5) for b in range(a + 1, g + 5)]
    e = edges(spark, make)
    assert sorted(list(r["members"]) for r in kernels.cliques(e, 3).collect()) == [[0, 1, 2, 3, 4], [4, 5, 6, 7, 8]]
    assert kernels.gce(e, 4).select("c").distinct().count() == 2
    assert kernels.eagle(e, 4).select("c").distinct().count() == 2
    assert detect.percolation(detect.clique_ids(kernels.cliques(e, 4)), 4).select("c").distinct().count() == 2
    assert rows(kernels.cliques(edges(spark, PATH), 3)) == []
    assert kernels.covering([[1, 2, 3]] * 4) == [[1, 2, 3]] * 2


def test_map_equation_prefers_groups(spark):
    make = [(a, b) for g in (0, 10) for a in range(g, g + 6) for b in range(a + 1, g + 6)] + [(0, 10)]
    e = edges(spark, make)
    two = graph.nodes(e).select(F.when(F.col("node") < 10, 0).otherwise(1).cast("long").alias("c"), "node")
    one = graph.nodes(e).select(F.lit(0).cast("long").alias("c"), "node")
    assert detect.map_equation(e, two).first()[0] < detect.map_equation(e, one).first()[0]
    pairs = kernels.adjacency(e.toPandas())
    label, length = kernels.infomap(pairs, 0, 2)
    found = spark.createDataFrame([(int(c), int(v)) for v, c in label.items()], "c long, node long")
    assert detect.map_equation(e, found).first()[0] == pytest.approx(length)


def test_copra_and_slpa(spark):
    e = edges(spark, TRIANGLES)
    for found in (detect.copra(e, 1), detect.slpa(e, 0.3, 15, 1).select("c", "node", F.lit(1.0).alias("belonging"))):
        for c, n, _ in rows(found):
            assert (c < 3) == (n < 3)
    assert rows(detect.slpa(e, 0.3, 5, 1)) == rows(detect.slpa(e.repartition(7), 0.3, 5, 1))


def test_significance_tails():
    tail, now = significance.hypergeometric_tail(2, 4, 5, 20)
    exact = sum(math.comb(5, x) * math.comb(15, 4 - x) for x in (3, 4)) / math.comb(20, 4)
    assert tail == pytest.approx(exact) and now == pytest.approx(math.comb(5, 2) * math.comb(15, 2) / math.comb(20, 4))
    assert significance.binomial_tail(2, 3, 0.5) == pytest.approx(0.5)


def test_homeless_nodes_are_housed(spark):
    e = edges(spark, TRIANGLES + [(2, 6)])
    out = significance.house(e, cov(spark, [0, 1, 2], [3, 4, 5]))
    assert (0, 6) in rows(out)
    assert len(significance.hierarchy(e, levels=2, runs=2)) <= 2


def test_hierarchy_of_louvain(spark):
    levels = kernels.louvain_hierarchy(edges(spark, TRIANGLES))
    assert levels.filter("level = 0").count() == 6
    assert rows(detect.aggregated(edges(spark, TRIANGLES), cov(spark, [0, 1, 2], [3, 4, 5]))) == [(0, 0, 6.0), (1, 1, 6.0)]


def test_generators(spark):
    e, c = generate.planted_partition(spark, 2, 10, 1.0, 0.0)
    assert e.count() == 90 and c.count() == 20
    assert generate.lattice(spark, 8, 8).count() == 112
    e, c = generate.lfr(spark, 150, 8, 20, 0.1, min_size=10, max_size=30, overlapping=5, seed=3)
    report = generate.mixing_report(e, c).first()
    assert report["mixing"] < 0.3 and report["p_in"] > 5 * report["p_out"]
    assert cover.overlapping(c).count() == 5
    before = graph.degrees(edges(spark, BOWTIE + [(5, 6), (7, 8)]))
    after = graph.degrees(generate.rewired(edges(spark, BOWTIE + [(5, 6), (7, 8)])))
    assert rows(before) == rows(after)
    assert rows(generate.planted_partition(spark, 2, 10, 0.5, 0.1, 4)[0]) == rows(generate.planted_partition(spark, 2, 10, 0.5, 0.1, 4)[0].repartition(3))
    assert generate.circular_layout(edges(spark, PATH), 2).count() == 4
    assert generate.configuration(spark, [2] * 12).count() <= 12


def test_experiments(spark):
    assert experiment.steps("0/0.3/0.1") == [0.0, 0.1, 0.2] and experiment.steps("4") == [4.0]
    e = edges(spark, TRIANGLES)
    table = experiment.run_grid(e, cov(spark, [0, 1, 2], [3, 4, 5]), [("kclique", {"k": 3}), ("louvain", {"t": 1.0})])
    top = {r["method"]: r["value"] for r in experiment.best(table).collect()}
    assert top == {"kclique": pytest.approx(1), "louvain": pytest.approx(1)}
    assert experiment.averaged(table, "t").count() > 0


def test_label_prediction(spark):
    labels = spark.createDataFrame([(v, 1 + v % 2) for v in range(60)] + [(99, 0)], "node long, label long")
    c = spark.createDataFrame([(v % 2, v) for v in range(60)], "c long, node long")
    kept, features = predict.filtered(c, labels)
    assert kept.count() == 60 and features.count() == 60
    got = predict.accuracy(c, labels, 5, 1, trees=2).first()
    assert got["accuracy"] == 1.0 and got["n"] == 12
    assert rows(predict.by_size(cov(spark, [1], [1, 2, 3], [3, 2, 1])))[0] == (0, 1)


def test_two_labels_take_one_model_a_fold(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.linalg import Vectors

    labels = spark.createDataFrame([(v, 1 + (v * v + v // 7) % 2) for v in range(120)], "node long, label long")
    c = spark.createDataFrame([(v * v % 7, v) for v in range(120)] + [(10 + v % 5, v) for v in range(120)], "c long, node long")
    rows_ = [(float((v * v + v // 7) % 2), Vectors.dense([float(v * v % 7 == i) for i in range(7)])) for v in range(120)]
    x = spark.createDataFrame(rows_, ["label", "features"])
    trees = GBTClassifier(maxIter=3, seed=0, subsamplingRate=0.4)
    one, each = trees.fit(x).transform(x), OneVsRest(classifier=trees).fit(x).transform(x)
    assert [r.prediction for r in one.collect()] == [r.prediction for r in each.collect()]
    fits, fit = [], GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, data: fits.append(1) or fit(self, data))
    got = predict.accuracy(c, labels, 5, 2, trees=2)
    assert len(fits) == 2 and [r["fold"] for r in got.collect()] == [0, 1]
    three = spark.createDataFrame([(v, 1 + v % 3) for v in range(60)], "node long, label long")
    assert predict.accuracy(spark.createDataFrame([(v % 3, v) for v in range(60)], "c long, node long"), three, 5, 1, trees=2).first()["accuracy"] == 1.0
    assert len(fits) == 5
