"""Readers and writers of files, on small literals."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, medoids
from loomgraph.plans import partition
from loomgraph.sources import readers, writers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_edge_lists(spark, tmp_path):
    p = put(tmp_path, "e", "1\t2\n2.0 3 {}\n# x\n\n3 1\n")
    assert rows(readers.edge_list(spark, p, shift=-1)) == [(0, 1), (1, 2), (2, 0)]
    p = put(tmp_path, "g", "#c\n1;2\n2,1\n3 3\n4x5\n")
    assert rows(readers.any_separator(spark, p)) == [(1, 2), (4, 5)]
    p = put(tmp_path, "w", "1 2 0.5\n2 2 1\n3 1 2 4\n")
    assert rows(readers.weighted(spark, p, True)) == [(1, 2, 1, 0.5), (1, 3, 4, 2.0)]
    assert rows(readers.weighted(spark, p, False, directed=True)) == [(1, 2, 1, 1.0), (3, 1, 2, 1.0)]
    with pytest.raises(Exception, match="not positive"):
        readers.weighted(spark, put(tmp_path, "bad", "1 2 -1\n"), True).collect()


def test_gml_and_pajek(spark, tmp_path):
    text = 'graph [\n node [ id 1 label "a b" value 2 graphics [ x 1 ] ]\n node [ id 2 ]\n edge [ source 1 target 2 weight 3.5 ]\n edge [ source 1 target 9 ]\n]'
    nodes, edges = readers.gml(spark, put(tmp_path, "x.gml", text))
    assert rows(nodes) == [(1, "a b", 2.0), (2, None, None)] and rows(edges) == [(1, 2, 3.5)]
    text = '*Vertices 3\r\n1 "n one" 2.5\r\n2 "two"\r\n3 x\r\n*Edges\r\n1 2 4\r\n*Arcs\r\n3 1\r\n'
    nodes, edges = readers.pajek(spark, put(tmp_path, "x.net", text))
    assert rows(nodes) == [(1, "n one", 2.5), (2, "two", 1.0), (3, "x", 1.0)]
    assert rows(edges) == [(1, 2, 4.0, False), (3, 1, 1.0, True)]
    assert rows(readers.pajek_classes(spark, put(tmp_path, "x.clu", "*Vertices 2\n5\n6\n"))) == [(5, 1), (6, 2)]
    assert rows(readers.graphml(spark, put(tmp_path, "x.graphml", '<graphml><edge id="e" source="n0" target="n1"/></graphml>'))) == [("n0", "n1")]


def test_covers(spark, tmp_path):
    p = put(tmp_path, "c", " 1 3 6\n2 3\n")
    assert rows(readers.cover(spark, p)) == [(0, 1), (0, 3), (0, 6), (1, 2), (1, 3)]
    assert rows(readers.cover(spark, p, 3)) == [(0, 1), (0, 3), (0, 6)]
    assert dict(rows(readers.truth_labels(spark, p)))[3] == "1, 2"
    p = put(tmp_path, "n", "1\t5 9 \n2\t5\n")
    assert rows(readers.node_communities(spark, p)) == [(0, 1), (0, 2), (1, 1)]
    assert rows(readers.node_communities(spark, p, only_first=True)) == [(0, 1), (0, 2)]
    p = put(tmp_path, "tp", "#module 0 size: 2 bs: 0.01\n1 2\n#module 1 size: 1 bs: 1\n3\n")
    assert rows(readers.modules(spark, p)) == [(0, 2, 0.01, 1), (0, 2, 0.01, 2)]
    assert len(rows(readers.modules(spark, p, "with_homeless"))) == 3


def test_tables(spark, tmp_path):
    edges, names = readers.autonomous_systems(spark, put(tmp_path, "as", "# x\n1.1\t7\n7\t1.1\n9\t7\n"))
    assert rows(edges) == [(0, 1), (0, 2)] and (2, 65537, "1.1") in rows(names)
    assert rows(readers.column(spark, put(tmp_path, "col", "1 2\n3 4\n"), 1)) == [(2.0,), (4.0,)]
    t = spark.createDataFrame([(1, -3), (2, 4)], "id int, year int")
    assert rows(readers.attribute(t, "id", "year")) == [(1, 0), (2, 4)]
    p = put(tmp_path, "s.csv", ',graph,statistic,value\n0,"bench_60,",n,1.5\n')
    assert rows(readers.score_table(spark, p)) == [("bench_60,", "n", 1.5)]


def test_round_trips(spark, tmp_path):
    c = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 10)], "c long, node long")
    writers.write_cover(c, str(tmp_path / "cover"))
    assert rows(readers.cover(spark, str(tmp_path / "cover"))) == rows(c)
    writers.write_modules(c.withColumn("score", F.lit(0.25)), str(tmp_path / "tp"))
    assert rows(readers.modules(spark, str(tmp_path / "tp")).select("c", "node")) == rows(c)
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    writers.write_edges(e, str(tmp_path / "edges"), both=True)
    assert rows(graph.canonical(readers.edge_list(spark, str(tmp_path / "edges"))).select("src", "dst")) == rows(e)
    nodes = graph.nodes(e).select(F.col("node").alias("id"), F.concat(F.lit("n"), "node").alias("name"))
    text = writers.pajek_text(nodes, e.withColumn("weight", F.lit(2.0)))
    back, links = readers.pajek(spark, put(tmp_path, "p.net", text))
    assert back.count() == 3 and rows(links.select("src", "dst", "weight")) == [(1, 2, 2.0), (2, 3, 2.0)]
    assert writers.classes_text(c.filter("c = 0")) == "*Vertices 2\n0\n0\n"
    assert writers.dump_text(c) == "2\n2 1 2\n2 2 10\n"
    assert rows(writers.clique_lines(c.withColumnRenamed("c", "clique")))[0] == (0, "0: 1 2")
    writers.write_network(spark.createDataFrame([(0, 1, 12)], "c1 long, c2 long, n long"), str(tmp_path / "net"))
    assert spark.read.text(str(tmp_path / "net")).first()[0] == "0\t1\t12"
    writers.write_scores(spark.createDataFrame([("g", "n", 1.5)], "graph string, statistic string, value double"), str(tmp_path / "scores"))
    assert spark.read.csv(str(tmp_path / "scores"), header=True).count() == 1
    stats = writers.level_statistics(c, graph.nodes(e), graph.degrees(e)).first()
    assert (stats["coverage"], stats["modules"], stats["homeless"]) == (3, 2, 1)
    flow = graph.nodes(e).withColumn("flow", F.lit(0.25))
    assert writers.tree_lines(spark.createDataFrame([(0, 1), (0, 2), (5, 3)], "c long, node long"), flow).orderBy("module", "place").first()["value"].startswith("1:1 0.25")


def test_documents(spark, tmp_path):
    d = spark.createDataFrame([(a, b, float(abs(a - b))) for a in range(1, 5) for b in range(1, 5)], "e1 long, e2 long, d double")
    poly = medoids.polynomial(d, 2)
    for dialect, word in (("lp", "min:"), ("cplex", "Minimize")):
        text = writers.model_text(poly, 4, 2, dialect)
        assert word in text and "y1 + y2 + y3 + y4 = 2" in text
    nodes = spark.createDataFrame([(1, "a&b", 1.0, 2.0, 3.0)], "id long, clusters string, r double, g double, b double")
    text = writers.gexf_text(nodes, spark.createDataFrame([(1, 1)], "src long, dst long"))
    assert 'value="a&amp;b"' in text and '<viz:color r="1" g="2" b="3"/>' in text


def test_command_line(spark, tmp_path):
    p = put(tmp_path, "bow", "0 1\n0 2\n1 2\n2 3\n2 4\n3 4\n")
    partition.main(["-i", p, "-k", "2", "-o", str(tmp_path / "out"), "-l"])
    assert spark.read.text(str(tmp_path / "out/cover")).count() == 2
    assert spark.read.text(str(tmp_path / "out/line-graph.gexf"), wholetext=True).first()[0].count("<edge ") == 10
