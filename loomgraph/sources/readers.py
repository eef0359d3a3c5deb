"""Readers of graph, cover and attribute files, as text parsed by DataFrame functions; line order comes from sorted partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.storage import numbered

NUMBERS = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a file, numbered from 0; carriage returns end lines too."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line", "value"))
    last = whole.select(F.size(F.split("value", "\r\n|\r|\n")).alias("n"))
    return parts.crossJoin(F.broadcast(last)).filter("line < n - 1 or value <> ''").select("line", "value")


def _fields(value: Column) -> Column:
    return F.split(F.trim(value), r"\s+")


def edge_list(spark: SparkSession, path: str, sep: str = r"\s+", shift: int = 0, comments: str = "#*", braces: bool = True) -> DataFrame:
    """(src, dst): two integers a line; "1.0" is 1; lines that start with a comment sign, and what follows the two, are skipped."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    if comments:
        rows = rows.filter(~F.substring(F.trim("value"), 1, 1).isin(*comments))
    f = F.split(F.trim("value"), sep)
    if not braces:
        rows = rows.filter(F.size(f) == 2)
    return rows.select(*[(f[i].cast("double").cast("long") + shift).alias(n) for i, n in enumerate(("src", "dst"))])


def any_separator(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst): the first two runs of digits of each line that is no comment, without self loops, both orders once."""
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*[#*]"))
    got = rows.select(F.regexp_extract_all("value", F.lit(r"(\d+)"), 1).alias("n")).filter(F.size("n") >= 2)
    a, b = F.col("n")[0].cast("long"), F.col("n")[1].cast("long")
    return got.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).filter("src <> dst").distinct()


def weighted(spark: SparkSession, path: str, weights: bool, directed: bool = False) -> DataFrame:
    """(src, dst, mult, weight) from two to four columns. With weights the third is the weight, which must be positive, and the
    fourth the multiplicity; without, the third, if above 0.99, is the multiplicity. Self loops go; undirected ends are ordered."""
    f = _fields(F.col("value"))
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    third, fourth = F.get(f, F.lit(2)).cast("double"), F.get(f, F.lit(3)).cast("double")
    if weights:
        weight = F.when(third > 0, third).when(third.isNull(), 1.0).otherwise(F.raise_error(F.concat(F.lit("weight not positive: "), F.col("value"))))
        mult = F.coalesce(F.when(fourth > 0.99, fourth), F.lit(1))
    else:
        weight, mult = F.lit(1.0), F.coalesce(F.when(third > 0.99, third), F.lit(1))
    out = rows.select(f[0].cast("long").alias("a"), f[1].cast("long").alias("b"), mult.cast("int").alias("mult"), weight.alias("weight")).filter("a <> b")
    ends = (F.col("a"), F.col("b")) if directed else (F.least("a", "b"), F.greatest("a", "b"))
    return out.select(ends[0].alias("src"), ends[1].alias("dst"), "mult", "weight")


def gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, value) and edges (src, dst, weight) of a GML file; an edge to an undeclared node is left out."""
    text = spark.read.text(path, wholetext=True)
    block = lambda kind: text.select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)\b{kind}\s*\[((?:[^\[\]]|\[[^\[\]]*\])*)\]"), 1)).alias("b"))
    field = lambda name, kind: F.nullif(F.regexp_extract("b", rf"(?m)(?:^|\s){name}\s+(?:\"([^\"]*)\"|(\S+))", 1), F.lit("")) if kind == "text" else F.nullif(F.regexp_extract("b", rf"(?:^|\s){name}\s+\"?({NUMBERS})", 1), F.lit("")).cast(kind)
    nodes = block("node").select(field("id", "long").alias("id"), field("label", "text").alias("label"), field("value", "double").alias("value"))
    edges = block("edge").select(field("source", "long").alias("src"), field("target", "long").alias("dst"), F.coalesce(field("weight", "double"), field("value", "double"), F.lit(1.0)).alias("weight"))
    known = nodes.select("id")
    return nodes, edges.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi").select("src", "dst", "weight")


def cover(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(c, node): one community a line, numbered from 0; communities below least nodes are left out."""
    rows = lines(spark, path).filter(F.trim("value") != "").select(F.col("line").cast("long").alias("c"), F.array_distinct(_fields(F.col("value"))).alias("m"))
    return rows.filter(F.size("m") >= least).select("c", F.explode("m").alias("m")).select("c", F.col("m").cast("long").alias("node"))


def node_communities(spark: SparkSession, path: str, only_first: bool = False) -> DataFrame:
    """(c, node) from lines of a node and its communities, renumbered from 0 in ascending order."""
    f = _fields(F.col("value"))
    more = F.slice(f, 2, 1) if only_first else F.slice(f, F.lit(2), F.size(f) - 1)
    rows = spark.read.text(path).filter(F.trim("value") != "").select(f[0].cast("long").alias("node"), F.explode(more).alias("x")).select(F.col("x").cast("long").alias("x"), "node")
    ids = rows.select("x").distinct().withColumn("c", F.dense_rank().over(Window.orderBy("x")).cast("long") - 1)  # a row for each community
    return rows.join(F.broadcast(ids), "x").select("c", "node").distinct()


def modules(spark: SparkSession, path: str, keep: str = "significant") -> DataFrame:
    """(c, size, bs, node) from headers "#module i size: s bs: b" and the lines of members after them.

    keep: "significant" (bs below 1), "anyway", or "with_homeless" (modules of one node too).
    """
    rows = lines(spark, path)
    rows = rows.withColumn("head", F.lag("value").over(Window.orderBy("line")))
    got = rows.filter("value not like '#%' and trim(value) <> '' and head like '#module%'")
    got = got.select(
        F.regexp_extract("head", r"#module\s+(\d+)", 1).cast("long").alias("c"), F.regexp_extract("head", r"size:\s*(\d+)", 1).cast("int").alias("size"),
        F.regexp_extract("head", rf"bs:\s*({NUMBERS})", 1).cast("double").alias("bs"), F.explode(_fields(F.col("value"))).alias("node"),
    )
    got = got.withColumn("node", F.col("node").cast("long"))
    if keep == "significant":
        return got.filter("bs < 1")
    return got if keep == "with_homeless" else got.filter("size > 1")


def truth_labels(spark: SparkSession, path: str) -> DataFrame:
    """(node, label): the communities' line numbers from 1, such as "1, 3"; leading spaces do not matter."""
    got = cover(spark, path).groupBy("node").agg(F.array_sort(F.collect_list(F.col("c") + 1)).alias("l"))
    return got.select("node", F.array_join(F.transform("l", lambda x: x.cast("string")), ", ").alias("label"))


def pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, weight) and edges (src, dst, weight, directed) of a Pajek file; weights default to 1."""
    rows = lines(spark, path).filter(F.trim("value") != "")
    order = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    part = F.when(F.col("value").rlike(r"^\s*\*"), F.lower(F.regexp_extract("value", r"\*(\w+)", 1)))
    rows = rows.withColumn("part", F.last(part, True).over(order)).filter(~F.col("value").rlike(r"^\s*[*%]"))
    v = F.trim("value")
    name = F.coalesce(F.nullif(F.regexp_extract(v, r"^\d+\s+\"([^\"]*)\"", 1), F.lit("")), F.regexp_extract(v, r"^\d+\s+(\S+)", 1))
    weight = F.regexp_extract(v, rf"^\d+\s+(?:\"[^\"]*\"|\S+)\s+({NUMBERS})", 1)
    nodes = rows.filter("part = 'vertices'").select(F.regexp_extract(v, r"^(\d+)", 1).cast("long").alias("id"), name.alias("name"), F.coalesce(F.nullif(weight, F.lit("")).cast("double"), F.lit(1.0)).alias("weight"))
    f = F.split(v, r"\s+")
    edges = rows.filter("part in ('edges', 'arcs')").select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"), F.coalesce(F.get(f, F.lit(2)).cast("double"), F.lit(1.0)).alias("weight"), (F.col("part") == "arcs").alias("directed"))
    return nodes, edges


def pajek_classes(spark: SparkSession, path: str) -> DataFrame:
    """(c, node) of a Pajek .clu file: the class of the n-th node is on the n-th line after the head."""
    return lines(spark, path).filter("line > 0 and trim(value) <> ''").select(F.trim("value").cast("long").alias("c"), F.col("line").cast("long").alias("node"))


def graphml(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) as text ids, from the edge elements of a GraphML file."""
    text = spark.read.text(path, wholetext=True)
    tags = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(<edge\b[^>]*>)"), 1)).alias("t"))
    return tags.select(F.regexp_extract("t", r"source\s*=\s*[\"']([^\"']*)", 1).alias("src"), F.regexp_extract("t", r"target\s*=\s*[\"']([^\"']*)", 1).alias("dst"))


def attribute(table: DataFrame, node: str, name: str) -> DataFrame:
    """(node, label): one attribute of a table; negative values are 0."""
    return table.select(F.col(node).cast("long").alias("node"), F.greatest(F.col(name).cast("long"), F.lit(0)).alias("label"))


def autonomous_systems(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) with dense ids from 0 in order of system numbers, and their labels (id, number, label).

    Tab-separated pairs; "a.b" is a 2^16 + b; comments and repeated links go.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)")).select(f[0].alias("a"), f[1].alias("b"))
    number = lambda c: F.when(F.instr(c, ".") > 0, F.split_part(c, F.lit("."), F.lit(1)).cast("long") * 65536 + F.split_part(c, F.lit("."), F.lit(2)).cast("long")).otherwise(c.cast("long"))
    pairs = rows.select(number(F.col("a")).alias("x"), number(F.col("b")).alias("y"), "a", "b")
    names = pairs.select(F.col("x").alias("number"), F.col("a").alias("label")).union(pairs.select("y", "b")).groupBy("number").agg(F.min("label").alias("label"))
    ids = numbered(names, "number", name="id", first=0)
    link = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    out = link.join(ids.select(F.col("number").alias("x"), F.col("id").alias("src")), "x").join(ids.select(F.col("number").alias("y"), F.col("id").alias("dst")), "y")
    return out.select("src", "dst"), ids.select("id", "number", "label")


def column(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(value): the k-th column, from 0, of a file of numbers."""
    f = _fields(F.col("value"))
    return spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)")).select(F.get(f, F.lit(k)).cast("double").alias("value")).filter("value is not null")


def score_table(spark: SparkSession, path: str) -> DataFrame:
    """(graph, statistic, value) from a CSV with a leading index column."""
    rows = spark.read.csv(path, header=True)
    return rows.select("graph", "statistic", F.col("value").cast("double").alias("value"))
