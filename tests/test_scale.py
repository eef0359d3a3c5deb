"""Steps that must not grow with more than their input: dense work stays in a component's task, joins are dealt by rows."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions import linalg, storage
from loomgraph.operators import graph, linegraph, medoids, metrics
from loomgraph.plans import community_queries, derived, partition


def rings(spark, *sizes):  # noqa: ANN001, ANN201
    """A graph of cycles, each with a chord."""
    rows, at = [], 0
    for n in sizes:
        rows += [(at + i, at + (i + 1) % n) for i in range(n)] + [(at, at + n // 2)]
        at += n
    return graph.with_ids(spark.createDataFrame(rows, "src long, dst long"))


def test_resistances_of_links_only(spark):  # noqa: ANN001
    e = rings(spark, 7, 9)
    lines = linegraph.line_graph(e)
    linked = linegraph.resistances(e, lines, "gamma", pairs="linked")
    assert linked.count() == lines.count()
    totals = {r[1] for r in linked.groupBy("component").agg(F.sum("r").alias("s"), F.lit(0)).select(F.lit(0), F.round("s", 6)).collect()}
    assert totals == {7.0, 9.0}  # 8 and 10 links, less one each
    plan = linegraph.amplified_commute(e, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.partition("FlatMapGroups")[0]  # pairs are not shuffled


def test_hops_are_those_of_a_search(spark):  # noqa: ANN001
    e = rings(spark, 11, 6)
    lines = linegraph.line_graph(e)
    want = graph.search(linegraph.line_links(lines), e.select(F.col("edge_id").alias("node")))
    got = linegraph.shortest_paths(e, lines, unreachable="drop")
    assert sorted(map(tuple, got.collect())) == sorted((r["source"], r["node"], float(r["d"])) for r in want.collect())
    mixed = linegraph._all_steps(e, lines, most=8)  # the larger ring by joins
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, got.collect()))
    a = np.zeros((2500, 2500), bool)
    i = np.arange(2499)
    a[i, i + 1] = a[i + 1, i] = True
    a[2300, 2301] = a[2301, 2300] = False
    d = linalg.hops(a)
    assert d[0, 2300] == 2300 and d[0, 2301] == -1 and d[2400, 2450] == 50


def test_two_medoids_are_always_proved():
    r = np.random.default_rng(3)
    x = r.random((260, 2))
    d = np.hypot(*(x[:, None] - x[None]).transpose(2, 0, 1))
    found, cost, gap = medoids.exact(d, 2, nodes=1)
    rounded = medoids.rounded(d)
    want = min(float(np.minimum(rounded[:, [i]], rounded[:, i + 1 :]).sum(0).min()) for i in range(259))
    assert gap == 0.0 and abs(cost - want) < 1e-6 and found == sorted(found)


def test_clusters_of_components_without_a_table_of_pairs(spark):  # noqa: ANN001
    e = rings(spark, 8, 5, 12)
    lines = linegraph.line_graph(e)
    for distance, f in (("acm", linegraph.amplified_commute), ("cm", linegraph.commute)):
        measure = linegraph.block_measure(f, lines)
        for algorithm in ("pmp", "pam", "kmd"):
            got = medoids.cluster_blocks(e, lines, measure, 3, algorithm)
            want = medoids.cluster_components(e, f(e, lines), 3, algorithm)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (distance, algorithm)
    assert partition.component_partition(e, 2).clusters.count() == 28


def test_pairs_are_dealt_by_rows(spark, tmp_path, monkeypatch):  # noqa: ANN001
    from loomgraph.functions import storage
    from loomgraph.plans import derived

    items = [(o, (o * 7 + i * i) % 31) for o in range(300) for i in range(4)] + [(None, 1), (5, None)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(p, f"Brand#{p % 3}", p % 50) for p in range(31)], "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    assert derived._together(spark, str(tmp_path), 2).rdd.getNumPartitions() == 49  # 4 pairs a row, 1,202 rows
    of = {}
    for o, p in items:
        if o is not None and p is not None:
            of.setdefault(o, set()).add(p)
    n = {}
    for ps in of.values():
        for a in ps:
            for b in ps:
                if a < b:
                    n[a, b] = n.get((a, b), 0) + 1
    got = [tuple(r) for r in derived.co_part(spark, str(tmp_path), 9).orderBy("edge_id").collect()]
    assert got == [(i + 1, *e) for i, e in enumerate(sorted(e for e, k in n.items() if k >= 9))]
    kin = {(r["src"], r["dst"]) for r in derived.kin_part(spark, str(tmp_path)).collect()}
    assert kin == {(a, b) for a, b in n if a % 3 == b % 3 and (a > 25) == (b > 25)}
    assert {(r["src"], r["dst"], r["weight"]) for r in derived.weighted(spark, str(tmp_path), 3).collect()} == {(*e, float(k)) for e, k in n.items() if k >= 3}


def test_graphs_without_links(spark):  # noqa: ANN001
    from loomgraph.operators import kernels

    e = graph.with_ids(spark.createDataFrame([], "src long, dst long"))
    assert kernels.eagle(e.select("src", "dst")).collect() == []
    run = partition.link_partition(e, 3, "gd", "kmn", 0.3)
    assert run.cover.collect() == [] and run.clusters.collect() == []


def orders_of(spark, folder):  # noqa: ANN001, ANN201
    rows = [(1, 5), (1, 7), (1, 7), (2, 7), (2, 9), (2, 11), (3, 4), (4, 20), (4, 21), (5, None), (None, 6), (5, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_nodes_and_components_without_pairs(spark, tmp_path, monkeypatch):  # noqa: ANN001
    d = orders_of(spark, tmp_path)
    e = derived.co_part(spark, d, 1)
    want = sorted(map(tuple, graph.components(e).collect())), sorted(r[0] for r in graph.nodes(e).collect())
    monkeypatch.setattr(derived, "_together", None)
    derived.co_part.cache_clear()
    assert sorted(map(tuple, community_queries.components_all(spark, d).collect())) == want[0]
    assert sorted(r[0] for r in derived.co_nodes(spark, d, 1).collect()) == want[1]


def test_rounds_move_one_side(spark):  # noqa: ANN001
    links = spark.range(50).select(F.col("id").alias("src"), (F.col("id") % 7).alias("dst"))
    kept = storage.laid_out(links, "src")
    met = kept.join(spark.range(50).toDF("src").hint("shuffle_hash"), "src")
    assert met.count() == 50
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 1 and "ShuffledHashJoin" in plan
    kept.unpersist()


def test_triangles_by_colours(spark, monkeypatch):  # noqa: ANN001
    r = np.random.default_rng(5)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in r.integers(100, 160, (500, 2)).tolist() if a != b})
    e = spark.createDataFrame(pairs, "src long, dst long")
    a = np.zeros((160, 160), int)
    for x, y in pairs:
        a[x, y] = a[y, x] = 1
    want = {i: t for i, t in enumerate((np.linalg.matrix_power(a, 3).diagonal() // 2).tolist()) if t}
    assert dict(map(tuple, metrics.triangle_counts(e).collect())) == want
    monkeypatch.setattr(metrics, "WEDGES", 10)
    low, high = np.array(pairs).T
    got = np.zeros(160, int)
    for cell in itertools.combinations_with_replacement(range(4), 3):
        for nodes, counts in metrics._closed(cell, low, high, 4):
            np.add.at(got, nodes, counts)
    assert {i: t for i, t in enumerate(got.tolist()) if t} == want


def test_omega_counts_pairs_without_making_them(spark):  # noqa: ANN001
    r = np.random.default_rng(5)
    for most in (1, 3):  # partitions, and covers that overlap; some nodes are in one cover only
        a = {(int(c), v) for v in range(40) if v % 7 for c in r.integers(0, 4, most)}
        b = {(int(c), v) for v in range(45) if v % 5 for c in r.integers(0, 3, most)}
        want = {}
        for u, v in itertools.combinations(range(45), 2):
            x, y = (sum((c, u) in s and (c, v) in s for c in range(4)) for s in (a, b))
            if x + y:
                want[x, y] = want.get((x, y), 0) + 1
        frames = [spark.createDataFrame(sorted(s), "c long, node long") for s in (a, b)]
        assert {(q["x"], q["y"]): q["k"] for q in metrics.shared_pairs(*frames).collect()} == want
    nodes = spark.range(400_000).toDF("node")
    one, two = nodes.select(F.lit(0).cast("long").alias("c"), "node"), nodes.select((F.col("node") % 2).alias("c"), "node")
    assert abs(metrics.omega(one, two).first()[0]) < 1e-9 and metrics.omega(two, two).first()[0] == 1.0  # 80 billion pairs


def test_cliques_only_around_triangles(spark):  # noqa: ANN001
    from loomgraph.operators import kernels

    tree = graph.with_ids(spark.createDataFrame([(i, i // 2) for i in range(1, 40)], "src long, dst long"))
    assert kernels.neighborhoods(tree).count() == 0 and kernels.cliques(tree).count() == 0 and kernels.cliques(tree, 2).count() == 39
    r = np.random.default_rng(2)
    links = {(a, b) for a, b in itertools.combinations(range(14), 2) if r.random() < 0.45}
    near = lambda s: all(p in links for p in itertools.combinations(s, 2))
    every = [s for k in range(1, 15) for s in itertools.combinations(range(14), k) if near(s)]
    maximal = [list(s) for s in every if not any(set(s) < set(t) for t in every)]
    e = graph.with_ids(spark.createDataFrame(sorted(links), "src long, dst long"))
    for least in (2, 3, 4):
        assert sorted(list(x["members"]) for x in kernels.cliques(e, least).collect()) == sorted(m for m in maximal if len(m) >= least)
