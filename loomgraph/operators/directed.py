"""Directed graphs: reading them as flow, the directed map equation and its search, and directed significance scores."""

from __future__ import annotations

from collections import defaultdict
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from loomgraph.operators.graph import pagerank
from loomgraph.operators.significance import MINIMUM, node_score

ALPHA = 0.15


def _plogp(x: float) -> float:
    return x * np.log2(x) if x > 1e-16 else 0.0


def codelength(edges: DataFrame, partition: DataFrame, alpha: float = ALPHA, ranks: DataFrame | None = None) -> DataFrame:
    """(codelength): bits a step of a directed walk with jumps under a partition (c, node); edges: src, dst, weight.

    A module's exit flow is that of its outer links and of jumps to other modules; dangling nodes jump always.
    """
    rank = pagerank(edges, alpha) if ranks is None else ranks
    n = rank.count()
    w = edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = w.groupBy("src").agg(F.sum("w").alias("out"))
    at = partition.select("c", "node").join(rank, "node").join(out.withColumnRenamed("src", "node"), "node", "left")
    jump = F.when(F.col("out").isNull(), F.col("rank")).otherwise(alpha * F.col("rank"))
    modules = at.groupBy("c").agg(F.sum("rank").alias("p"), F.sum(jump).alias("jump"), (F.count("*") / n).alias("share"))
    links = w.join(out, "src").join(at.select(F.col("c").alias("a"), F.col("node").alias("src"), "rank"), "src").join(partition.toDF("b", "dst"), "dst")
    leave = links.filter("a <> b").groupBy(F.col("a").alias("c")).agg(F.sum((1 - alpha) * F.col("rank") * F.col("w") / F.col("out")).alias("links"))
    q = modules.join(leave, "c", "left").select("p", (F.coalesce("links", F.lit(0.0)) + F.col("jump") * (1 - F.col("share"))).alias("q"))
    plogp = lambda x: F.when(x > 1e-16, x * F.log2(x)).otherwise(0.0)
    sums = q.agg(F.sum("q").alias("q"), F.sum(plogp(F.col("q"))).alias("lq"), F.sum(plogp(F.col("q") + F.col("p"))).alias("lqp"))
    own = rank.agg(F.sum(plogp(F.col("rank"))).alias("lp"))
    return sums.crossJoin(own).select((plogp(F.col("q")) - 2 * F.col("lq") + F.col("lqp") - F.col("lp")).alias("codelength"))


def infomap(edges: DataFrame, alpha: float = ALPHA, seed: int = 0, trials: int = 3) -> DataFrame:
    """(c, node): the partition of least codelength of seeded searches by moves of nodes and of modules; a kernel over the graph.

    The steady state is found by joins (pagerank); the kernel holds links and ranks.
    """
    rank = {r["node"]: r["rank"] for r in pagerank(edges, alpha).collect()}
    w = edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")).withColumn("g", F.lit(0))
    n = len(rank)

    def kernel(pairs: pd.DataFrame) -> pd.DataFrame:
        total: dict[int, float] = defaultdict(float)
        for s, x in zip(pairs["src"].tolist(), pairs["weight"].tolist(), strict=True):
            total[s] += x
        flow = [(s, d, (1 - alpha) * rank[s] * x / total[s]) for s, d, x in zip(pairs["src"].tolist(), pairs["dst"].tolist(), pairs["weight"].tolist(), strict=True)]
        jump = {v: rank[v] * (alpha if v in total else 1.0) for v in rank}
        entropy = sum(map(_plogp, rank.values()))

        def moves(groups: list[list[int]], label: dict[int, int], r: np.random.Generator) -> float:
            where = {v: i for i, g in enumerate(groups) for v in g}
            out: list[dict[int, float]] = [defaultdict(float) for _ in groups]
            into: list[dict[int, float]] = [defaultdict(float) for _ in groups]
            for s, d, f in flow:
                a, b = where[s], where[d]
                if a != b:
                    out[a][b] += f
                    into[b][a] += f
            p, t, k = ([sum(x) for x in y] for y in ([[rank[v] for v in g] for g in groups], [[jump[v] for v in g] for g in groups], [[1.0] * len(g) for g in groups]))
            module = [label[g[0]] for g in groups]
            state: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])  # links out, rank, jumps, nodes
            for i in range(len(groups)):
                s = state[module[i]]
                s[0] += sum(f for j, f in out[i].items() if module[j] != module[i])
                s[1] += p[i]
                s[2] += t[i]
                s[3] += k[i]
            leave = lambda s: s[0] + s[2] * (1 - s[3] / n)
            terms = lambda s: -2 * _plogp(leave(s)) + _plogp(leave(s) + s[1])
            q = sum(map(leave, state.values()))
            length = lambda: _plogp(q) + sum(map(terms, state.values())) - entropy
            now = length()
            while True:
                for i in r.permutation(len(groups)):
                    a = module[i]
                    to: dict[int, float] = defaultdict(float)
                    back: dict[int, float] = defaultdict(float)
                    for j, f in out[i].items():
                        to[module[j]] += f
                    for j, f in into[i].items():
                        back[module[j]] += f
                    every = sum(out[i].values())
                    sa = state[a]
                    less = [sa[0] - (every - to.get(a, 0.0)) + back.get(a, 0.0), sa[1] - p[i], sa[2] - t[i], sa[3] - k[i]]
                    best, pick = -1e-10, None
                    for c in sorted({*to, *back} - {a}):
                        sc = state[c]
                        more = [sc[0] + (every - to.get(c, 0.0)) - back.get(c, 0.0), sc[1] + p[i], sc[2] + t[i], sc[3] + k[i]]
                        dq = leave(less) + leave(more) - leave(sa) - leave(sc)
                        change = _plogp(q + dq) - _plogp(q) + terms(less) + terms(more) - terms(sa) - terms(sc)
                        if change < best:
                            best, pick = change, (c, more, dq)
                    if pick:
                        c, more, dq = pick
                        state[a], state[c], module[i] = less, more, c
                        q += dq
                new = length()
                if now - new < 1e-10:
                    break
                now = new
            for g, c in zip(groups, module, strict=True):
                for v in g:
                    label[v] = c
            return now

        found: tuple[float, dict[int, int]] = (np.inf, {})
        for trial in range(trials):
            r = np.random.default_rng([seed, trial])
            label = {v: v for v in rank}
            now = np.inf
            while True:
                new = moves([[v] for v in sorted(rank)], label, r)
                modules: dict[int, list[int]] = defaultdict(list)
                for v in sorted(rank):
                    modules[label[v]].append(v)
                new = min(new, moves(list(modules.values()), label, r))
                if now - new < 1e-10:
                    break
                now = new
            if now < found[0] - 1e-12:
                found = (now, dict(label))
        smallest: dict[int, int] = {}
        for v in sorted(found[1]):
            smallest.setdefault(found[1][v], v)
        return pd.DataFrame({"c": [smallest[found[1][v]] for v in sorted(rank)], "node": sorted(rank)})

    return w.groupBy("g").applyInPandas(kernel, "c long, node long")


def both(a: float, b: float) -> float:
    """The chance that the product of two uniform numbers is at most a b."""
    x = max(a * b, MINIMUM)
    return min(1.0, x * (1 - log(x)))


def weight_score(weight: float, links: int) -> float:
    """The chance that as many exponential weights of mean 1 sum to at least weight: a gamma tail."""
    if links <= 0:
        return 1.0
    term, total = exp(-weight), 0.0
    for i in range(links):
        total += term
        term *= weight / (i + 1)
    return max(min(total, 1.0), MINIMUM) if weight < 700 else MINIMUM


def score_modules(edges: DataFrame, cover: DataFrame, weighted: bool = False) -> DataFrame:
    """(c, node, score): each member's score in a directed graph, in-links from and out-links to its module taken together.

    With weights (over the mean of a node's side) their gamma tails are taken together with the counts' tails.
    """
    m = edges.count()
    c = cover.select("c", "node").distinct()
    side = lambda a, b: edges.select(F.col(a).alias("node"), F.col(b).alias("other"), "weight")
    out = c
    for name, links in (("out", side("src", "dst")), ("in", side("dst", "src"))):
        degree = links.groupBy("node").agg(F.count("*").alias(f"d_{name}"), F.avg("weight").alias(f"m_{name}"))
        inside = links.join(c, "node").join(c.withColumnRenamed("node", "other"), ["c", "other"], "left_semi")
        inside = inside.groupBy("c", "node").agg(F.count("*").alias(f"k_{name}"), F.sum("weight").alias(f"w_{name}"))
        out = out.join(degree, "node", "left").join(inside, ["c", "node"], "left")
    names = [f"{x}_{s}" for s in ("out", "in") for x in "dkmw"]
    out = out.na.fill(0, names)
    totals = out.groupBy("c").agg(F.sum("d_in").alias("t_in"), F.sum("d_out").alias("t_out"))

    @pandas_udf(DoubleType())
    def score(d_out: pd.Series, k_out: pd.Series, m_out: pd.Series, w_out: pd.Series, d_in: pd.Series, k_in: pd.Series, m_in: pd.Series, w_in: pd.Series, t_in: pd.Series, t_out: pd.Series) -> pd.Series:
        rows = []
        for do, ko, mo, wo, di, ki, mi, wi, ti, to in zip(d_out, k_out, m_out, w_out, d_in, k_in, m_in, w_in, t_in, t_out, strict=True):
            a, b = node_score(int(ko), int(do), int(ti - di), int(m - di)), node_score(int(ki), int(di), int(to - do), int(m - do))
            if weighted:
                a = both(a, weight_score(wo / mo if mo else 0.0, int(ko)))
                b = both(b, weight_score(wi / mi if mi else 0.0, int(ki)))
            rows.append(max(both(a, b), MINIMUM))
        return pd.Series(rows, dtype="float64")

    return out.join(totals, "c").select("c", "node", score(*names, "t_in", "t_out").alias("score"))
