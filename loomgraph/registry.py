"""Named strategies: distances (edges, lines) -> (e1, e2, d), clusterings (edges, dist, k, seed) -> (edge_id, cluster_id),
and detectors (edges, **params) -> (c, node). Add your own with register_*."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import detect, egos, graph, kernels, leiden, linegraph, medoids, significance

DISTANCES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "sp": lambda edges, lines: linegraph.shortest_paths(edges, lines).filter("e1 < e2"),
    "gd": linegraph.generalised_degree,
    "cm": linegraph.commute,
    "acm": linegraph.amplified_commute,
}
CLUSTERINGS: dict[str, Callable[..., DataFrame]] = {"pmp": medoids.cluster_exact, "kmd": medoids.cluster_clarans, "pam": medoids.cluster_pam, "kmn": medoids.cluster_kmeans}


def _percolation(edges: DataFrame, k: int = 4) -> DataFrame:
    return detect.percolation(detect.clique_ids(kernels.cliques(edges, k)), k)


def _link_partition(edges: DataFrame, k: int = 2, **options) -> DataFrame:  # noqa: ANN003
    """The core method over the whole graph, or with components=True over each of its components."""
    from loomgraph.plans import partition

    run = partition.component_partition if options.pop("components", False) else partition.link_partition
    return run(edges, k, **options).cover


METHODS: dict[str, Callable[..., DataFrame]] = {
    "link_partition": _link_partition,
    "leiden": leiden.leiden,
    "demon": egos.demon,
    "egonet_splitter": egos.ego_splitting,
    "louvain": kernels.louvain,
    "infomap": kernels.infomap_partition,
    "gce": lambda edges, **p: kernels.gce(edges, **p).select("c", "node"),
    "eagle": kernels.eagle,
    "oslom": lambda edges, **p: significance.significant_modules(edges, **p).select("c", "node"),
    "label_propagation": detect.label_propagation,
    "copra": lambda edges, **p: detect.copra(edges, **p).select("c", "node"),
    "slpa": lambda edges, **p: detect.slpa(edges, **p).select("c", "node"),
    "kclique": _percolation,
    "components": lambda edges: graph.components(edges).select(F.col("component").alias("c"), "node"),
}


def register_distance(name: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    DISTANCES[name] = f


def register_clustering(name: str, f: Callable[..., DataFrame]) -> None:
    CLUSTERINGS[name] = f


def register_method(name: str, f: Callable[..., DataFrame]) -> None:
    METHODS[name] = f
