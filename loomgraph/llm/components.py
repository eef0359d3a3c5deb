"""Connected components of an edge table, by large-star and small-star contraction; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of every node of edges (u long, v long) other than the roots; root: the smallest id it reaches.

    Large-star hangs each node's larger neighbours on its smallest neighbour, small-star its smaller ones; both keep the
    components, and stars of a root are all that remains. Self loops and repeated edges are allowed; an empty table gives
    an empty result. Groups are only ever aggregated (min), never collected.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    stamp = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u")
        hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct()
        now = written(hung, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == stamp:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        stamp = seen
    raise RuntimeError("components did not settle")
