"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from loomgraph.operators import graph
from loomgraph.plans.derived import co_part
from loomgraph.plans.queries import ORACLES, QUERIES
from loomgraph.streaming import ingest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
SOME = ("edges_canonical", "degree", "line_graph", "components", "split_communities", "nearest_medoid", "membership_counts", "threshold_cover", "module_network", "community_scores", "cover_quality", "onmi_lfk", "omega", "f1_scores", "clustering_coefficient", "map_equation", "median_polynomial", "label_features", "event_degrees", "club_generalised_degree", "club_amplified_commute", "club_clusters", "club_cover", "clique_percolation", "label_propagation", "suppressed_cover", "link_clusters", "link_members", "link_partition_exact", "distance_shortest_path", "directed_border_scores")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query(spark, tables, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), tables.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda x: sorted(map(str, x[columns].itertuples(index=False, name=None)))
    assert text(got) == text(want) and len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.limit(200).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.distinct_edges(ingest.event_edges(stream)).writeStream.format("memory").queryName("edges").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = ingest.event_edges(spark.read.parquet(str(tmp_path / "in"))).select("src", "dst").distinct().count()
    assert spark.table("edges").count() == want


def test_whole_graph_in_core_queries(spark):
    """The flagship and edge betweenness take the links of two orders, not the fewer of three."""
    links = co_part(spark, DATA, 2)
    assert QUERIES["edge_betweenness"](spark, DATA).count() == links.count() > co_part(spark, DATA, 3).count()
    few = {r["node"] for r in graph.nodes(co_part(spark, DATA, 3)).collect()}
    assert {r["node"] for r in __spark_entry__.entry(spark).collect()} - few


def test_queries_run_at_the_operators_defaults(spark, monkeypatch):
    from loomgraph.operators import detect, kernels, significance
    from loomgraph.plans import predict

    asked = {}
    for module, f in ((kernels, "infomap_partition"), (detect, "label_propagation"), (detect, "copra"), (detect, "slpa"), (significance, "significant_modules"), (predict, "accuracy")):
        monkeypatch.setattr(module, f, lambda df, *a, f=f, **b: (asked.update({f: (a, b)}), df)[1])
    for name in ("infomap", "label_propagation", "copra", "slpa", "significant_modules", "label_accuracy"):
        QUERIES[name](spark, DATA)
    assert asked["copra"] == ((2,), {}) and asked["slpa"] == ((0.2,), {}) and len(asked["accuracy"][0]) == 1
    assert all(not b for _, b in asked.values()) and not asked["infomap_partition"][0] and not asked["label_propagation"][0] and not asked["significant_modules"][0]
