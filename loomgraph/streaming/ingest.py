"""An extra beyond batch graphs: edges from a stream, duplicates dropped within a watermark, and degrees by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_edges(events: DataFrame) -> DataFrame:
    """(ts, src, dst): users and event kinds as a bipartite graph; works on batch and streaming tables."""
    kind = F.xxhash64("event_type")
    return events.select("ts", F.col("user_id").alias("src"), kind.alias("dst"))


def distinct_edges(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each edge once within the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["src", "dst"])


def windowed_degrees(edges: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, node, n): links of each source in each window."""
    source = edges.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if edges.isStreaming else edges
    at = source.groupBy(F.window("ts", width).alias("w"), F.col("src").alias("node")).agg(F.count("*").alias("n"))
    return at.select(F.col("w.start").alias("start"), "node", "n")
