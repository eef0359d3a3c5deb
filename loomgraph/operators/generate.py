"""Benchmark graphs: planted partitions and block models as hashed samples of pairs, and LFR, configuration and lattice graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _coin(seed: int, *columns: str) -> Column:
    """A uniform number of a pair, from a seeded hash: the same whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / (1 << 40)


def block_model(spark: SparkSession, sizes: list[int], p: list[list[float]], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) and cover (c, node): pairs of blocks i and j are linked with probability p[i][j]. All pairs are drawn."""
    ends = np.cumsum(sizes)
    node = spark.range(int(ends[-1])).select(F.col("id").alias("node"))
    block = F.lit(0)
    for i, e in enumerate(ends[:-1], 1):
        block = F.when(F.col("node") >= int(e), i).otherwise(block)
    cover = node.select(block.cast("long").alias("c"), "node")
    table = F.array(*[F.array(*map(F.lit, row)) for row in p])
    pairs = cover.toDF("a", "src").join(cover.toDF("b", "dst"), F.col("src") < F.col("dst"))
    return pairs.filter(_coin(seed, "src", "dst") < table[F.col("a").cast("int")][F.col("b").cast("int")]).select("src", "dst"), cover


def planted_partition(spark: SparkSession, groups: int, size: int, p_in: float, p_out: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    return block_model(spark, [size] * groups, [[p_in if i == j else p_out for j in range(groups)] for i in range(groups)], seed)


def connected(make, seed: int, tries: int = 100):  # noqa: ANN001, ANN201
    """The first of make(seed), make(seed + 1), ... whose edges connect all nodes of the cover."""
    from loomgraph.operators.graph import components

    for s in range(seed, seed + tries):
        edges, cover = make(s)
        if components(edges, cover).select("component").distinct().count() == 1:
            return edges, cover
    raise RuntimeError(f"no connected graph in {tries} tries")


def girvan_newman(spark: SparkSession, z_out: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Four groups of 32 nodes with mean degree 16, z_out of it to other groups."""
    return planted_partition(spark, 4, 32, (16 - z_out) / 31, z_out / 96, seed)


def lattice(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    n = spark.range(1, rows * columns + 1)
    right = n.filter(F.col("id") % columns != 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return right.union(n.filter(F.col("id") <= (rows - 1) * columns).select("id", F.col("id") + columns))


def power_law(r: np.random.Generator, n: int, low: float, high: int, exponent: float) -> np.ndarray:
    """Integers from low to high with probability proportional to x^-exponent."""
    x = np.arange(max(1, int(np.ceil(low))), high + 1)
    p = x.astype(float) ** -exponent
    return r.choice(x, n, p=p / p.sum())


def least_degree(mean: float, high: int, exponent: float) -> int:
    """The smallest degree of a power law up to high whose mean is nearest to the wanted one."""
    best = (np.inf, 1)
    for low in range(1, high + 1):
        x = np.arange(low, high + 1)
        p = x.astype(float) ** -exponent
        best = min(best, (abs(float((x * p).sum() / p.sum()) - mean), low))
    return best[1]


def _pairs(stubs: np.ndarray, r: np.random.Generator, taken: set, allowed, rounds: int = 200) -> None:  # noqa: ANN001
    """Match stubs at random into simple allowed links; what cannot be matched is rewired with links made before, or left."""
    rest = stubs.copy()
    for _ in range(rounds):
        if len(rest) < 2:
            return
        r.shuffle(rest)
        left = [rest[-1]] if len(rest) % 2 else []
        for a, b in zip(rest[0 : len(rest) - 1 : 2].tolist(), rest[1::2].tolist(), strict=False):
            e = (min(a, b), max(a, b))
            if a != b and e not in taken and allowed(a, b):
                taken.add(e)
            else:
                left += [a, b]
        rest = np.array(left, np.int64)


def configuration(spark: SparkSession, degree: list[int], seed: int = 0) -> DataFrame:
    """A simple graph with about the given degrees (nodes from 0)."""
    taken: set = set()
    _pairs(np.repeat(np.arange(len(degree)), degree), np.random.default_rng(seed), taken, lambda a, b: True)
    return spark.createDataFrame(sorted((int(a), int(b)) for a, b in taken), "src long, dst long")


def lfr(spark: SparkSession, n: int, mean_degree: float, max_degree: int, mixing: float, t1: float = 2.0, t2: float = 1.0, min_size: int = 10, max_size: int = 50, overlapping: int = 0, memberships: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) and cover (c, node), nodes from 1: power-law degrees and community sizes, a share mixing of each node's
    links to nodes with which it shares no community, and ``overlapping`` nodes in ``memberships`` communities each."""
    r = np.random.default_rng(seed)
    degree = power_law(r, n, least_degree(mean_degree, max_degree, t1), max_degree, t1)
    own = np.ones(n, np.int64)
    own[r.choice(n, overlapping, replace=False)] = memberships
    inner = np.round((1 - mixing) * degree).astype(np.int64)
    sizes: list[int] = []
    while sum(sizes) < own.sum():
        sizes.append(int(power_law(r, 1, min_size, max_size, t2)[0]))
    sizes[-1] -= sum(sizes) - int(own.sum())
    if sizes[-1] < min_size and len(sizes) > 1:
        extra = sizes.pop()
        for i in range(extra):
            sizes[i % len(sizes)] += 1
    room, homes = np.array(sizes), [set() for _ in range(n)]
    for v in np.argsort(-inner, kind="stable"):  # nodes of many inner links first, into communities large enough
        for _ in range(own[v]):
            fits = [c for c in range(len(room)) if room[c] > 0 and c not in homes[v] and sizes[c] > inner[v] / own[v]] or [c for c in range(len(room)) if room[c] > 0 and c not in homes[v]]
            c = int(r.choice(fits)) if fits else int(r.integers(len(room)))
            homes[v].add(c)
            room[c] -= 1
    taken: set = set()
    for c in range(len(sizes)):
        mine = np.array([v for v in range(n) if c in homes[v]])
        _pairs(np.repeat(mine, [int(round(inner[v] / len(homes[v]))) for v in mine]), r, taken, lambda a, b: True)
    _pairs(np.repeat(np.arange(n), degree - inner), r, taken, lambda a, b: not homes[a] & homes[b])
    edges = spark.createDataFrame(sorted((int(a) + 1, int(b) + 1) for a, b in taken), "src long, dst long")
    return edges, spark.createDataFrame(sorted((c, v + 1) for v in range(n) for c in homes[v]), "c long, node long")


def mixing_report(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(p_in, p_out, mixing, deviation): link densities within and between communities, and the nodes' outer shares."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("node", "other")
    near = both.join(cover.toDF("c", "node"), "node").join(cover.toDF("c2", "other").withColumnRenamed("c2", "c"), ["c", "other"], "left_semi").select("node", "other").distinct()
    share = both.groupBy("node").agg(F.count("*").alias("k")).join(near.groupBy("node").agg(F.count("*").alias("i")), "node", "left").select("k", F.coalesce("i", F.lit(0)).alias("i"))
    pairs = cover.toDF("c", "u").join(cover.toDF("c", "v"), "c").filter("u < v").select("u", "v").distinct().count()
    n = cover.select("node").distinct().count()
    rest = max(n * (n - 1) // 2 - pairs, 1)
    return share.agg((F.sum("i") / 2 / max(pairs, 1)).alias("p_in"), (F.sum(F.col("k") - F.col("i")) / 2 / rest).alias("p_out"), F.avg(1 - F.col("i") / F.col("k")).alias("mixing"), F.stddev_pop(1 - F.col("i") / F.col("k")).alias("deviation"))


def rewired(edges: DataFrame, swaps_per_edge: int = 10, seed: int = 0) -> DataFrame:
    """A simple graph of the same degrees after seeded swaps of link ends; a driver kernel."""
    r = np.random.default_rng(seed)
    e = [tuple(x) for x in edges.select("src", "dst").orderBy("src", "dst").collect()]
    have = set(e)
    for _ in range(swaps_per_edge * len(e)):
        i, j = r.integers(len(e), size=2)
        (a, b), (c, d) = e[i], e[j]
        if r.random() < 0.5:
            c, d = d, c
        x, y = (min(a, d), max(a, d)), (min(c, b), max(c, b))
        if len({a, b, c, d}) == 4 and x not in have and y not in have:
            have -= {e[i], e[j]}
            have |= {x, y}
            e[i], e[j] = x, y
    return edges.sparkSession.createDataFrame(sorted((int(a), int(b)) for a, b in have), "src long, dst long")


def circular_layout(edges: DataFrame, sweeps: int = 20, seed: int = 0) -> DataFrame:
    """(node, x, y): nodes on a circle, swapped as long as that shortens the links; a driver kernel."""
    rows = edges.select("src", "dst").toPandas().to_numpy()
    ids = np.unique(rows)
    ends = np.searchsorted(ids, rows)
    near: list[list[int]] = [[] for _ in ids]
    for a, b in ends:
        near[a].append(b)
        near[b].append(a)
    at, r, n = np.arange(len(ids)), np.random.default_rng(seed), len(ids)
    xy = np.stack([np.cos(2 * np.pi * np.arange(n) / n), np.sin(2 * np.pi * np.arange(n) / n)], 1)
    length = lambda v: np.linalg.norm(xy[at[near[v]]] - xy[at[v]], axis=1).sum()
    for _ in range(sweeps * n):
        u, v = r.integers(n, size=2)
        before = length(u) + length(v)
        at[u], at[v] = at[v], at[u]
        if length(u) + length(v) >= before - 1e-12:
            at[u], at[v] = at[v], at[u]
    return edges.sparkSession.createDataFrame([(int(i), float(xy[at[k]][0]), float(xy[at[k]][1])) for k, i in enumerate(ids)], "node long, x double, y double")
