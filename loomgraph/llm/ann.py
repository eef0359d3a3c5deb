"""Approximate nearest neighbours by cross-polytope hashing.

A vector, scaled to unit length, is turned by pseudo-rotations (random signs and a fast Hadamard transform, three times) and
falls to the nearest signed axis; ``hashes`` such codes make a bucket of a table. Each query probes, in each of ``tables``
tables, the ``probes`` buckets whose axes lie nearest to it, best first. The vectors of these buckets are candidates, which
are reranked by their exact Euclidean distance in double precision.

On 64-dimensional unit vectors in weak clusters (nearest neighbours 60 degrees away) 12 tables of one hash and 10 probes find
over 0.95 of the true neighbours among 2,000 to 51,000 vectors. For more vectors, raise ``hashes`` and ``probes``.

Scale: equal vectors are one entry with its smallest k + 1 ids (a group limit that each map task applies first), so groups of
copies cost no more than one vector. Every entry is indexed in every table. A bucket's entries, and the queries that probe it,
are split into blocks of about ``block`` rows, and each block of entries meets each block of queries; a group holds one of
each, however many rows a bucket has. Only each block's best k for a query move on.

Defined cases: vectors that are null or zero, hold a null or a non-finite value, or whose length is not the table's most
frequent one take no part, as query or candidate; equal rows count once; a query's own vec_id is no candidate; fewer
candidates than k are all returned if found; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import written


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Hadamard transform over the last axis, whose length is a power of two."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.concatenate([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], -1).reshape(x.shape)
        h *= 2
    return x / np.sqrt(n)


def signed_axes(x: np.ndarray, table: int, one: int, seed: int) -> np.ndarray:
    """Closeness of each unit vector to each signed axis after the pseudo-rotation of a table's hash."""
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, table, one]).choice([-1.0, 1.0], (3, n))
    y = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    for s in signs:
        y = hadamard(y * s)
    return np.concatenate([y, -y], 1)


def buckets(x: np.ndarray, table: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """The codes of the buckets to probe, best first, for each vector (not all zero); the first is the vector's own."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = [signed_axes(x, table, h, seed) for h in range(hashes)]
    axes = near[0].shape[1]
    wide = min(axes, probes)
    best = [np.argsort(-s, 1, kind="stable")[:, :wide] for s in near]
    loss = [np.square(np.take_along_axis(s, b[:, :1], 1) - np.take_along_axis(s, b, 1)) for s, b in zip(near, best, strict=True)]
    codes, losses = best[0].astype(np.int64), loss[0]
    for b, one in zip(best[1:], loss[1:], strict=True):
        pairs = list(product(range(codes.shape[1]), range(wide)))
        i, j = np.array(pairs).T
        codes, losses = codes[:, i] * axes + b[:, j], losses[:, i] + one[:, j]
        first = np.argsort(losses, 1, kind="stable")[:, :probes]
        codes, losses = np.take_along_axis(codes, first, 1), np.take_along_axis(losses, first, 1)
    return codes


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("vec")
        flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("ids"), pa.array([v.tobytes() for v in flat], pa.binary())], ["ids", "vec"])


def _hasher(tables: int, hashes: int, probes: int, seed: int, key: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                x = _vectors(part.column("vec"))
                for t in range(tables):
                    codes = buckets(x, t, hashes, probes, seed)
                    rows = pa.array(np.repeat(np.arange(len(x)), codes.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(codes.size, t, np.int32)), pa.array(codes.ravel()), part.column(key).take(rows), part.column("vec").take(rows)], ["t", "code", key, "vec"])

    return run


def _reranker(k: int):  # noqa: ANN202
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            x = np.frombuffer(b"".join(index["vec"]), "<f8").reshape(len(index), -1)
            all_ids, norms = index["ids"].to_list(), (x * x).sum(1)
            for a in range(0, len(queries), 256):
                part = queries.iloc[a : a + 256]
                q = np.frombuffer(b"".join(part["vec"]), "<f8").reshape(len(part), -1)
                rough = norms[None] + (q * q).sum(1)[:, None] - 2 * q @ x.T
                take = min(k + 1, len(x)) - 1
                edge = np.partition(rough, take, 1)[:, take]
                for i, own in enumerate(part["query_id"]):
                    near = np.flatnonzero(rough[i] <= edge[i] + 1e-9 * (1 + norms.max() + (q[i] ** 2).sum()))
                    exact = np.sqrt(np.square(x[near] - q[i]).sum(1))
                    found = sorted((s, v) for s, n in zip(exact.tolist(), near, strict=True) for v in all_ids[n] if v != own)
                    out += [(own, v, s) for s, v in found[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def usable(vec: Column) -> Column:
    """Whether a vector takes part: no null or non-finite value and not all zero."""
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = 12, hashes: int = 1, probes: int = 10, block: int = 4096, seed: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query; vectors: vec_id, embedding."""
    good = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"), is_query.alias("q")).filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    lengths = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = lengths[0]["n"] if lengths else 1
    good = good.filter(F.size("vec") == size).withColumn("vec", F.transform("vec", lambda v: v + F.lit(0.0)))  # -0.0 is 0.0
    copies = Window.partitionBy("vec").orderBy("vec_id")
    few = good.select("vec_id", "vec").distinct().withColumn("rn", F.row_number().over(copies)).filter(F.col("rn") <= k + 1)
    entries = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "vec")
    entries = written(entries.mapInArrow(_pack, "ids array<long>, vec binary"), "vectors")
    asked = good.filter("q").select(F.array("vec_id").alias("ids"), "vec").distinct().mapInArrow(_pack, "ids array<long>, vec binary")
    asked = asked.select(F.col("ids")[0].alias("query_id"), "vec")

    index = written(entries.mapInArrow(_hasher(tables, hashes, 1, seed, "ids"), "t int, code long, ids array<long>, vec binary"), "index")
    sizes = index.groupBy("t", "code").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    index = index.join(F.broadcast(sizes), ["t", "code"]) if hashes == 1 else index.join(sizes, ["t", "code"])
    index = index.withColumn("b", F.pmod(F.xxhash64("vec"), "blocks").cast("int")).drop("blocks")
    probe = asked.mapInArrow(_hasher(tables, hashes, probes, seed, "query_id"), "t int, code long, query_id long, vec binary")
    probe = written(probe, "probes")
    asks = probe.groupBy("t", "code").agg(F.ceil(F.count("*") / block).cast("int").alias("query_blocks"))
    index = index.join(F.broadcast(asks) if hashes == 1 else asks, ["t", "code"])  # buckets that no query probes are left out
    index = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).drop("query_blocks")
    probe = probe.join(F.broadcast(asks) if hashes == 1 else asks, ["t", "code"])
    probe = probe.withColumn("qb", F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int")).drop("query_blocks")
    probe = probe.join(F.broadcast(sizes) if hashes == 1 else sizes, ["t", "code"])
    probe = probe.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ["t", "code", "b", "qb"]
    found = index.groupBy(keys).cogroup(probe.groupBy(keys)).applyInPandas(_reranker(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
