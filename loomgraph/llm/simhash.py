"""Near-duplicate texts by SimHash fingerprints and pigeonhole blocks.

A text's words (runs of characters other than the space and U+0009 to U+000D, A-Z lowered) give its shingles, repeats included;
each is hashed by XXH64, and a bit of the fingerprint is set if it is set in over half of the hashes. Fingerprints that differ in
at most ``bits`` places link; documents get the connected component.

Blocks. The 64 bits are split into m blocks. Two linked fingerprints differ in at most ``bits`` of them, so they agree on all of
some m - bits blocks; each choice of m - bits blocks is a table, and rows of a table meet that agree on its blocks. m is the
smallest number for which a bucket would hold about ``BUCKET`` of the distinct fingerprints if they were spread evenly, so keys
grow with the corpus and the pairs compared grow linearly; every m finds every link. Each meeting is verified by the Hamming
distance, inside its task, and what leaves is a forest of links, fewer than the bucket has members.

Scale. Texts are read where they lie; what moves is (doc_id, fingerprint) and a row of 16 bytes a distinct fingerprint and table.
Exact copies are one fingerprint. Buckets of more than ``BLOCK`` members, as clusters of near copies make, are counted by an
aggregate and dealt out as pairs of blocks. That is quadratic in the distinct fingerprints of such a bucket, not in its rows.

Defined cases: null texts and texts without words have fingerprint zero, which links like any other; a text of fewer words than
a shingle is one shingle; repeated rows share their component; a null doc_id is no smallest id: its component_id is the smallest
other one, or null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import LOWER, UPPER, small_enough, slices, to_python, written
from loomgraph.llm.components import components

PIECE = 1 << 18  #: bytes of a text that are words at a time
BUCKET = 256  #: fingerprints a bucket is to hold when they are spread evenly
BLOCK = 4096  #: members of a bucket on each side of a comparison
HOT = 100_000  #: documents of a fingerprint beyond which its label is broadcast
BROADCAST_ROWS = 2_000_000
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, words: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, a piece of the text at a time."""
    held: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        gap = _SPACE.search(text, at + PIECE)
        stop = gap.start() if gap else len(text)
        here = held + text[at:stop].translate(_LOWERED).split()
        at = stop
        if len(here) >= words:
            some = True
            joined = b" ".join(here)
            ends = np.cumsum(np.fromiter(map(len, here), np.int64, len(here)) + 1) - 1
            starts = np.concatenate([[0], ends[: len(here) - words] + 1]).tolist()
            yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
        held = here[-(words - 1) :] if words > 1 else []
    if held and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], np.uint64)


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The fingerprint, as a signed number."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words, seed):
        for a in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[a : a + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (long) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t.as_py() or b"", words, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return to_python(texts).mapInArrow(run, "doc_id long, fp long")


def tables(n: int, bits: int = 4, bucket: int = BUCKET) -> list[int]:
    """The masks of the tables for n fingerprints: bits of m - bits of m blocks."""
    m = bits + 1
    while m < min(64, 2 * bits) and (64 // m) * (m - bits) < 62 and n > bucket << ((64 // m) * (m - bits)):
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    masks = [sum(chosen) for chosen in combinations(blocks, m - bits)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


KEYS = ["t", "key", "bi", "bj"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints and sides of each group of two or more, from rows sorted by KEYS."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in KEYS], 1)
        fp, side = batch.column("fp").to_numpy(), batch.column("side").to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and not (keys[a] == last).all():
                if len(held) > 1 or len(held[0][0]) > 1:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append((fp[a:b], side[a:b]))
            last = keys[a]
    if held and (len(held) > 1 or len(held[0][0]) > 1):
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def forest(fp: np.ndarray, side: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join all fingerprints of a group that links join; with two sides, those between the sides only."""
    x = fp.view(np.uint64)
    label = np.arange(len(x))
    two = side.any()
    right = np.flatnonzero(side) if two else label
    if len(x) <= 64:
        pairs = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= bits, 1)) if not two else np.argwhere((np.bitwise_count(x[:, None] ^ x[None]) <= bits) & (side[:, None] < side[None]))
        near = ((i, np.array([j])) for i, j in pairs.tolist())
    else:
        near = ((i, (js := right if two else right[i + 1 :])[np.bitwise_count(x[js] ^ x[i]) <= bits]) for i in (np.flatnonzero(side == 0) if two else range(len(x) - 1)))
    us, vs = [], []
    for i, js in near:
        while len(js := js[label[js] != label[i]]):
            j = js[0]
            us.append(fp[i])
            vs.append(fp[j])
            label[label == label[j]] = label[i]
    return np.array(us, np.int64), np.array(vs, np.int64)


def near_links(fps: DataFrame, bits: int = 4, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links of distinct fingerprints fps (fp) whose components are those of all pairs at most bits apart."""
    masks = tables(fps.count(), bits, bucket)
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    large = rows.groupBy("t", "key").count().filter(F.col("count") > block)
    large = written(large.select("t", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-buckets")
    if large.limit(1).count():
        dealt = rows.join(F.broadcast(large) if small_enough(large, BROADCAST_ROWS) else large, ["t", "key"], "left")
        dealt = dealt.withColumn("own", F.coalesce(F.pmod(F.xxhash64("fp"), "blocks"), F.lit(0)).cast("int"))
        dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    else:
        dealt = rows.withColumn("own", F.lit(0)).withColumn("to", F.lit(0))
    dealt = dealt.select("t", "key", F.least("own", "to").alias("bi"), F.greatest("own", "to").alias("bj"), (F.col("own") > F.col("to")).cast("int").alias("side"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, side in _groups(batches):
            us, vs = forest(fp, side, bits)
            if len(us):
                yield pa.RecordBatch.from_arrays([pa.array(us), pa.array(vs)], ["u", "v"])

    return dealt.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, words: int = 4, seed: int = 42, bits: int = 4, block: int = BLOCK, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text); block, bucket, hot: see BLOCK, BUCKET, HOT."""
    rows = written(fingerprints(docs, words, seed), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("m"), F.count("*").alias("c")), "classes")
    links = written(near_links(classes.select("fp"), bits, block, bucket).distinct(), "near-fingerprints")
    roots = components(links)
    labelled = classes.join(roots.select(F.col("id").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = labelled.groupBy("root").agg(F.min("m").alias("component_id"))
    labels = written(labelled.join(smallest, "root").select("fp", "component_id", "c"), "labels")
    if small_enough(labels, BROADCAST_ROWS):
        return rows.join(F.broadcast(labels.drop("c")), "fp").select("doc_id", "fp", "component_id")
    often = labels.filter(F.col("c") > hot).select("fp", F.col("component_id").alias("often"))  # at most a row for each hot documents
    often = F.broadcast(often) if small_enough(often, BROADCAST_ROWS) else often
    known = written(rows.join(often, "fp", "left"), "labelled-often")
    found = known.filter("often is null").join(labels.filter(F.col("c") <= hot), "fp", "left").select("doc_id", "fp", "component_id")
    return known.filter("often is not null").select("doc_id", "fp", F.col("often").alias("component_id")).union(found)


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    got = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
