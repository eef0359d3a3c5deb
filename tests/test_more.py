"""Directed graphs, hierarchies, vectors, caches and the steps of significant modules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import cache, vectors
from loomgraph.operators import directed, graph, levels, significance
from loomgraph.operators.kernels import adjacency


def groups(near_size=8, n=4):
    return [(a, b) for g in range(0, 10 * n, 10) for a in range(g, g + near_size) for b in range(a + 1, g + near_size)] + [(g, (g + 10) % (10 * n)) for g in range(0, 10 * n, 10)]


def test_directed(spark):
    pairs = [(a, b, 1.0) for a, b in groups(5, 2)] + [(b, a, 1.0) for a, b in groups(5, 2)]
    e = spark.createDataFrame(pairs, "src long, dst long, weight double")
    found = directed.infomap(e, trials=2)
    assert {n for c, n in found.collect() if c == 0} == {0, 1, 2, 3, 4}
    ranks = graph.pagerank(e)
    one = found.select(F.lit(0).cast("long").alias("c"), "node")
    assert directed.codelength(e, found, ranks=ranks).first()[0] < directed.codelength(e, one, ranks=ranks).first()[0]
    lone = directed.codelength(e, one, ranks=ranks).first()[0]
    assert lone == pytest.approx(-sum(r["rank"] * np.log2(r["rank"]) for r in ranks.collect()))
    for weighted in (False, True):
        good = directed.score_modules(e, found, weighted).agg(F.max("score")).first()[0]
        mixed = found.select((F.col("node") % 2).alias("c"), "node")
        assert good < directed.score_modules(e, mixed, weighted).agg(F.max("score")).first()[0]


def test_scores():
    assert directed.both(0.5, 1.0) == pytest.approx(0.5 * (1 - np.log(0.5)))
    assert directed.weight_score(2.0, 1) == pytest.approx(np.exp(-2)) and directed.weight_score(1.0, 0) == 1


def test_steps_of_significant_modules():
    import pandas as pd

    near = adjacency(pd.DataFrame(groups(), columns=["src", "dst"]))
    stubs = sum(map(len, near.values()))
    whole = set(range(8))
    assert significance.clean_up(near, whole | {33}, stubs) == whole
    assert significance.inflate(near, set(range(5)), 1) >= set(range(5))
    assert significance.union_or_parts(near, whole | set(range(10, 18)), [whole, set(range(10, 18))]) == [whole, set(range(10, 18))]
    assert significance.check_intersections(near, [whole, set(range(7)), set(range(10, 18))]) == [whole, set(range(10, 18))]


def test_seeds_and_fusion(spark):
    e = spark.createDataFrame(groups(), "src long, dst long")
    c = spark.createDataFrame([(0, v) for v in [*range(8), 33]], "c long, node long")
    assert sorted(r["node"] for r in significance.cleaned_seeds(e, c).collect()) == list(range(8))
    cover = spark.createDataFrame([(g, v) for g in range(4) for v in range(10 * g, 10 * g + 8)], "c long, node long")
    assert significance.fuse(e, cover).count() == 32


def test_levels(spark):
    rows = [(0, 0, 0), (1, 1, 0), (2, 2, 1), (3, 3, 1), (4, 0, 0), (5, 1, 0)]
    tree = levels.parsed(spark.createDataFrame(rows, "line long, child long, parent long"))
    assert sorted(map(tuple, levels.cut(tree, 0).collect())) == [(0, 0), (0, 1), (1, 2), (1, 3)]
    assert {c for c, _ in levels.cut(tree, 1).collect()} == {0} and levels.all_levels(tree).count() == 8


def test_vectors(spark):
    t = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], [[1.0, 2.0], [0.0, 1.0]])], "a array<double>, b array<double>, m array<array<double>>")
    a, b = F.col("a"), F.col("b")
    got = t.select(vectors.dot(a, b), vectors.norm(a), vectors.unit(a), vectors.orthogonal(a, b), vectors.applied(F.col("m"), a), vectors.jaccard(a, b)).first()
    assert tuple(got)[:2] == (3.0, 5.0) and got[2] == pytest.approx([0.6, 0.8]) and tuple(got)[3:] == ([0.0, 4.0], [11.0, 4.0], 0.0)


def test_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1,)], "x int")

    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    for frame, force in ((rows, False), (rows.repartition(3), False), (rows, True), (rows.filter("i = 1"), False)):
        assert cache.kept(str(tmp_path), frame, make, "acm", 3, force=force).count() == 1
    assert len(made) == 3


def test_clean_up_goes_on_until_nothing_changes():
    near = {}
    for i in range(300):
        near[i], near[i + 1000] = {i + 1000: 1.0}, {i: 1.0}
    assert significance.clean_up(near, set(range(300)), 600) == set()
