"""Hierarchies (level, child, parent) as trees: parsing printed ones, flat cuts, and the leaves of every inner node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.storage import written


def parsed(lines: DataFrame) -> DataFrame:
    """(level, child, parent) from printed lines (line, child, parent): a level ends where the child's id falls.

    A running count over lines: a printed tree is one file.
    """
    by = Window.orderBy("line")
    fell = (F.col("child") < F.lag("child").over(by)).cast("int")
    return lines.withColumn("level", F.coalesce(F.sum(fell).over(by), F.lit(0)).cast("int")).select("level", "child", "parent")


def cut(tree: DataFrame, level: int) -> DataFrame:
    """(c, node): the nodes' classes after the given level (0 for the first)."""
    now = tree.filter("level = 0").select(F.col("parent").alias("c"), F.col("child").alias("node"))
    for i in range(1, level + 1):
        step = tree.filter(F.col("level") == i).select(F.col("child").alias("c"), F.col("parent").alias("up"))
        now = written(now.join(step, "c").select(F.col("up").alias("c"), "node"), "cut")
    return now


def all_levels(tree: DataFrame) -> DataFrame:
    """(level, c, node): the leaves of every inner node of every level."""
    levels = (tree.agg(F.max("level")).first()[0] or 0) + 1 if tree.limit(1).count() else 0
    out = None
    for i in range(levels):
        one = cut(tree, i).select(F.lit(i).alias("level"), "c", "node")
        out = one if out is None else out.union(one)
    return out if out is not None else tree.select("level", F.col("parent").alias("c"), F.col("child").alias("node"))
