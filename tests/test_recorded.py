"""Recorded values of small public graphs: link-graph sizes, covers and graph statistics."""

import pytest

from loomgraph.operators import cover, graph, linegraph, metrics
from loomgraph.plans import experiment, known, partition
from loomgraph.plans.known import KARATE

# fixed values: links of a benchmark graph of 30 nodes with its planted communities
BENCH = """
1-29 1-30 2-29 2-30 3-24 3-29 4-12 4-17 5-27 5-28 6-23 6-25 7-8 7-28 8-25 9-26 9-28 10-11 10-19 11-19 12-19 12-27 13-24 13-29 13-30 14-22 14-25 14-26
15-24 15-29 15-30 16-21 16-23 16-27 17-19 17-20 18-21 18-29 18-30 20-21 20-22 20-27 21-26 21-30 22-23 22-27 22-28 23-26 23-28 23-30 24-27 24-29 24-30
25-26 25-27 25-28 26-28 27-28 28-29 29-30
"""
PLANTED = [[1, 2, 3, 13, 15, 18, 21, 24, 29, 30], [4, 10, 11, 12, 17, 19], [5, 6, 7, 8, 9, 12, 14, 16, 20, 21, 22, 23, 25, 26, 27, 28]]
CLUB = [[1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 13, 14, 17, 18, 20, 22], [9, 10, 15, 16, 19, 21, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34]]


def links(spark, text):
    return spark.createDataFrame(known.links(text), "src long, dst long")


def communities(spark, lists):
    return spark.createDataFrame([(c, v) for c, m in enumerate(lists) for v in m], "c long, node long")


@pytest.mark.parametrize(("text", "size", "lines"), [(KARATE, 78, 528), (BENCH, 60, 260)])
def test_line_graph_sizes(spark, text, size, lines):
    e = graph.with_ids(links(spark, text))
    assert e.count() == size and linegraph.line_graph(e).count() == lines


def test_recorded_statistics(spark):
    e = links(spark, BENCH)
    got = {r["statistic"]: r["value"] for r in metrics.graph_statistics(e, communities(spark, PLANTED)).collect()}
    want = {
        "nodes": 30, "edges": 60, "communities": 3, "overlapping_nodes": 2, "average_clustering": 0.419021, "normalized_cut": 0.194453,
        "internal_edge_density": 0.094907, "significance_recorded": 85.313112, "average_internal_degree": 3.294444, "modularity_density": 0.856458,
    }
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("distance", ["acm", "cm"])
def test_exact_partition_of_the_club(spark, distance):
    """The exact method gives two communities of 17 and 18 nodes that share one, at some threshold."""
    run = partition.link_partition(links(spark, KARATE), 2, distance, "pmp")
    members = run.members.collect()
    found = set()
    for t in range(1, 20):
        sides = [{r["node"] for r in members if r["c"] == c and r["belonging"] >= t / 20} for c in (1, 2)]
        found.add((tuple(sorted(map(len, sides))), len(sides[0] & sides[1]), len(sides[0] | sides[1])))
    assert ((17, 18), 1, 34) in found
    if distance == "acm":
        cov = run.members.filter("belonging >= 0.5").select("c", "node")
        scores = experiment.scores(cov, communities(spark, CLUB), graph.nodes(run.edges))
        assert scores["onmi_max"] > 0.5 and cover.sizes(cov).count() == 2
