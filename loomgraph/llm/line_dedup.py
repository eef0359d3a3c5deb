"""Line dedup by site-relative frequency, in DataFrame functions only.

For each host, the pages that contain a line are divided by the host's pages; a line above ``max_ratio``, on at least
``min_pages`` pages of the host, is boilerplate of that host and is dropped from all its pages, each time it stands there.

Lines are compared by two 64-bit hashes, so only 16 bytes a line move. Each page's lines are made distinct before they are
counted, so a plain count, partially aggregated where the pages are read, gives pages. Pages never shuffle when the hosts'
boilerplate lists are under a checked size: they are broadcast, each as an array of about as many small buckets as it has
lines, so that a line is looked up by its hash, and the texts are filtered where they are read; beyond it the pages' lines, as
hashes and positions, are joined by (host, line), which spreads a hot host over its lines. Either way takes time in proportion
to the lines.

``min_pages`` is a guard beside the ratio: in a host of few pages a single page is already a large share, and without it all
its lines would go. 1 switches it off.

Defined cases: very long texts are split and filtered whole; a null text stays null, with no lines; an empty text is one empty line; empty lines are never dropped; null hosts form one host; repeated rows
are pages of their own; an empty table gives an empty result; columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import small_enough, written

BROADCAST_LINES = 100_000


def _hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(17), line).alias("b"))


def boilerplate(pages: DataFrame, host: str = "source", max_ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """(_host, l, pages, host_pages) of the lines that are boilerplate of their host; l: the line's two hashes."""
    site = F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))
    lines = pages.select(site.alias("_host"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter("line != ''")
    counts = lines.select("_host", _hashes(F.col("line")).alias("l")).groupBy("_host", "l").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    totals = pages.groupBy(site.alias("_host")).agg(F.count("*").alias("host_pages"))
    return counts.join(totals, "_host").filter(F.col("pages") > F.lit(max_ratio) * F.col("host_pages"))


def _tables(drop: DataFrame) -> DataFrame:
    """(_host, _drop): the lines to drop of each host by buckets, a power of two of them; a line is in bucket a mod their number."""
    sizes = drop.groupBy("_host").agg(F.pow(F.lit(2), F.ceil(F.log2(F.count("*")))).cast("int").alias("nb"))
    slots = sizes.select("_host", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"))
    own = drop.join(sizes, "_host").groupBy("_host", F.pmod("l.a", "nb").cast("int").alias("b")).agg(F.collect_list("l").alias("ls"))
    whole = slots.join(own, ["_host", "b"], "left").select("_host", "b", F.coalesce("ls", F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")).alias("ls"))
    return whole.groupBy("_host").agg(F.sort_array(F.collect_list(F.struct("b", "ls"))).alias("t")).select("_host", F.col("t.ls").alias("_drop"))


def dedup_lines(pages: DataFrame, host: str = "source", max_ratio: float = 0.05, min_pages: int = 3, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """pages with text filtered, and the columns n_lines and n_dropped."""
    pages = pages.drop("n_lines", "n_dropped", "_host", "_drop")
    site = F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))
    drop = written(boilerplate(pages, host, max_ratio, min_pages).select("_host", "l"), "boilerplate")
    lines = F.split("text", "\n")
    if small_enough(drop, broadcast_lines):
        marked = pages.withColumn("_host", site).join(F.broadcast(_tables(drop)), "_host", "left").withColumn("_lines", lines)
        bucket = lambda x: F.get("_drop", F.pmod(F.xxhash64(x), F.size("_drop")).cast("int"))
        kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: (x == "") | ~F.array_contains(bucket(x), _hashes(x))))
        out = marked.withColumn("_kept", kept)
    else:
        marked = written(pages.withColumn("_host", site).withColumn("_row", F.monotonically_increasing_id()), "pages")
        each = marked.select("_row", "_host", F.posexplode(lines).alias("_at", "line")).filter("line != ''").select("_row", "_host", "_at", _hashes(F.col("line")).alias("l"))
        gone = each.join(drop, ["_host", "l"], "left_semi").groupBy("_row").agg(F.collect_set("_at").alias("_gone"))
        out = marked.join(gone, "_row", "left").withColumn("_lines", lines)
        stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
        out = out.withColumn("_kept", F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.get("_lines", i))))
    out = out.withColumn("n_lines", F.coalesce(F.size("_lines"), F.lit(0))).withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    out = out.withColumn("n_dropped", F.col("n_lines") - F.greatest(F.coalesce(F.size("_kept"), F.lit(0)), F.lit(0)))
    return out.withColumn("text", F.array_join("_kept", "\n")).select(*pages.columns, F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return dedup_lines(docs, "source", 0.05, 3).select("doc_id", "text", "n_lines", "n_dropped")


OP2_SQL = r"""
WITH l AS (SELECT doc_id, coalesce('=' || source, '') AS host, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
t AS (SELECT coalesce('=' || source, '') AS host, count(*) AS host_pages FROM documents GROUP BY 1),
b AS (SELECT l.host, line FROM l JOIN t ON l.host = t.host WHERE line <> '' GROUP BY l.host, line, host_pages
      HAVING count(*) >= 3 AND count(*) > CAST(0.05 AS DOUBLE) * host_pages),
s AS (SELECT doc_id, coalesce('=' || source, '') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT s.doc_id, s.host, u.i, s.ls[u.i] AS line FROM s, LATERAL (SELECT unnest(range(1, len(s.ls) + 1)) AS i) u),
k AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) AS kept, count(*) AS n FROM e LEFT JOIN b ON e.host = b.host AND e.line = b.line WHERE b.line IS NULL GROUP BY 1)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text,
       CAST(coalesce(len(s.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(s.ls), 0) - coalesce(k.n, 0) AS BIGINT) AS n_dropped
FROM s LEFT JOIN k ON s.doc_id = k.doc_id
"""
