"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

A text's set is its distinct five-word shingles (fewer words: the whole sequence as one shingle). A document leaks an item
when it holds at least ``threshold`` of the item's shingles. Items are partitioned by the size q of their sets into bands of
doubling size, [2^b, 2^(b+1)). All items of a band have a bottom-k MinHash sketch of one width, that of its greatest size
Q = 2^(b+1) - 1: k = Q - ceil(threshold Q) + 1. As q - ceil(threshold q) never falls when q grows, k is over q - ceil(threshold q)
for every item of the band. A leaking document lacks at most q - ceil(threshold q) of the shingles, so it holds all but that many
of the k sketch values: that number of hits, at least one, is the lossless bound on the containment that the sketch tells, and
pairs below it are dropped. Documents, long as they are, are not sketched: each of their shingle hashes is probed in the
sketches. Candidates are then verified by exact containment, on the shingles' words.

Scale: the sketches, a few rows an item, are broadcast while their bytes are within a checked bound and probed where the
documents are read, within code generation; only hits move. Verification reads candidate documents again, found by a semi join
of checked size. Beyond the bound the same joins run by hash exchange, and the rows of a hash that many documents hold are
dealt out by document over SALTS partitions. No pairs are made but those of a match.

Defined cases: a null text or one without words leaks nothing and is leaked by nothing; an item without an id is no item; rows
of one item_id are one item, whose set is all their shingles; rows of one doc_id are judged one by one and the greatest share is
told; a null doc_id is a value like others; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import GAP, lowered, written

BROADCAST_BYTES = 128 << 20
ROW_BYTES = 64
SALTS = 16


def _fits(df: DataFrame, limit: int, *texts: str) -> bool:
    """Whether df, at ROW_BYTES a row and the bytes of its text columns, is within limit; df is a written table."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(ROW_BYTES))
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def _looked_up(probed: DataFrame, table: DataFrame, on: list[str], limit: int, *texts: str) -> DataFrame:
    """The rows of probed with those of table; a key may be in a great part of probed."""
    if _fits(table, limit, *texts):
        return probed.join(F.broadcast(table), on)
    dealt = probed.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "t"), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*on, "_salt"]).drop("_salt")


def _only(df: DataFrame, kept: DataFrame, limit: int) -> DataFrame:
    """The rows of df whose columns are those of a row of kept, nulls as values."""
    keys = kept.columns
    kept = kept.select(*[F.col(c).alias(f"_{c}") for c in keys])
    kept = F.broadcast(kept) if _fits(kept, limit) else kept
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return df.join(kept, same, "left_semi")


def _shingles(texts: DataFrame, keys: list[str], words: int, threshold_hash: bool) -> DataFrame:
    """A row for each shingle position: the keys and h, the hash of the shingle's words, or s, its text."""
    gone = F.split(F.trim(F.regexp_replace(lowered(F.col("text")), GAP, " ")), " ")
    w = texts.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*keys, gone.alias("w"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - words, F.lit(0)))).alias("i")
    each = w.select(*keys, "w", at)
    parts: list[Column] = [F.get("w", F.col("i") + j) for j in range(words)]
    return each.select(*keys, F.xxhash64(*parts).alias("h")) if threshold_hash else each.select(*keys, F.concat_ws(" ", *parts).alias("s"), F.xxhash64(*parts).alias("h"))


def sketches(wanted: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(h, item_id, band, k, q, need, hits): the k smallest hashes of each item of wanted (item_id, h, s), k being its band's.

    need is the least number of shingles a leaking document holds, hits the least number of those in the sketch.
    """
    by_item = Window.partitionBy("item_id")
    least = lambda q: F.ceil(q * F.lit(threshold) - 1e-9)
    sized = wanted.withColumn("q", F.count("*").over(by_item)).withColumn("need", least(F.col("q")))
    sized = sized.withColumn("band", F.length(F.bin("q")) - 1).withColumn("top", F.expr("shiftleft(2L, band) - 1"))
    sized = sized.withColumn("k", F.col("top") - least(F.col("top")) + 1)
    ranked = sized.withColumn("r", F.dense_rank().over(by_item.orderBy("h"))).filter("r <= k")
    hits = F.greatest(F.max("r").over(by_item) - (F.col("q") - F.col("need")), F.lit(1))
    return ranked.withColumn("hits", hits).select("h", "item_id", "band", "k", "q", "need", "hits").distinct()


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.75, words: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of every document and item whose containment is at least threshold."""
    items = items.select("item_id", "text").filter("item_id IS NOT NULL")
    wanted = written(_shingles(items, ["item_id"], words, False).distinct(), "items")
    sketch = written(sketches(wanted, threshold), "sketch")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    probed = _shingles(docs, ["doc_id", "t"], words, True)
    met = _looked_up(probed, sketch.select("h", "item_id", "hits"), ["h"], broadcast_bytes).distinct()
    near = met.groupBy("doc_id", "t", "item_id").agg(F.count("*").alias("n"), F.max("hits").alias("hits")).filter("n >= hits")
    pairs = written(near.select("doc_id", "t", "item_id"), "candidates")
    some = written(pairs.select("doc_id", "t").distinct(), "candidate-texts")
    again = _only(docs, some, broadcast_bytes).dropDuplicates(["doc_id", "t"])
    held = _looked_up(_shingles(again, ["doc_id", "t"], words, False), wanted, ["h", "s"], broadcast_bytes, "s").distinct()
    held = _only(held, pairs, broadcast_bytes).groupBy("doc_id", "t", "item_id").agg(F.count("*").alias("n_shared"))
    needs = sketch.select("item_id", F.col("q").alias("n_item"), "need").distinct()
    needs = F.broadcast(needs) if _fits(sketch, broadcast_bytes) else needs
    out = held.join(needs, "item_id").filter("n_shared >= need")
    return out.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """docs without those that leak an item; a null doc_id is matched as a value."""
    bad = written(leaks(docs, items, threshold).select(F.col("doc_id").alias("_bad")).distinct(), "leaky")
    bad = F.broadcast(bad) if _fits(bad, BROADCAST_BYTES) else bad
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
b AS (SELECT item_id, [x FOR x IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY 1, 2 HAVING count(*) * 4 >= any_value(n_item) * 3
"""
