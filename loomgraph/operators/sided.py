"""Clean-up of modules in directed and weighted graphs: the border tests of cleanup with scores of each side of a node.

A directed node has two sides, its links out and its links in; an undirected one has one. On each side the links to the module's free
stubs of the other side follow the configuration model, which gives P(X > x) and P(X = x); between P(X > x) and P(X >= x) a score is
drawn, once a run. With weights, each over the mean of its node's side, the sum of the x weights to the module has a gamma tail, if
weights are exponential. Tails of counts and weights, then those of the two sides, are taken together: the chance that a product of two
uniform numbers is no larger. All is tables and joins, one round of border tests for all modules at once, so that no module, hub or
graph has to fit a task.

Defined cases: links from a node to itself do not count, weights of repeated links add up, null or non-positive weights are refused by
a filter beforehand; nodes without a link on a side have the count's score there and no weight; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.storage import numbered, written
from loomgraph.operators import cover as covers
from loomgraph.operators import modules
from loomgraph.operators.cleanup import LOW, clean_up, draws, hypergeometric, network

OTHER = {"out": "in", "in": "out", "any": "any"}  #: the side of the module that a side of a node links to


def product_tail(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The chance that the product of two uniform numbers is at most a b."""
    x = np.clip(np.asarray(a, np.float64) * b, LOW, 1.0)
    return np.minimum(x * (1 - np.log(x)), 1.0)


def gamma_tail(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The chance that x exponential numbers of mean 1 sum to w or more; 1 for none."""
    x, w = np.asarray(x, np.int64), np.asarray(w, np.float64)
    total, term, left = np.zeros(len(x)), np.exp(-w), np.arange(len(x))
    for i in range(int(x.max()) if len(x) else 0):
        left = left[x[left] > i]
        total[left] += term[left]
        term[left] *= w[left] / (i + 1)
    return np.where(x > 0, np.clip(total, LOW, 1.0), 1.0)


def together(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], u: list, weighted: bool) -> np.ndarray:
    """One score from tail, mass and weight tail of each side; u: where between the tails each side's score lies."""
    sides = []
    for (tail, now, heavy), at in zip(parts, u, strict=True):
        score = np.clip(tail + at * now, LOW, 1.0)
        sides.append(product_tail(score, heavy) if weighted else score)
    return np.maximum(reduce(product_tail, sides), LOW)


class Sided:
    """The null model of a graph (src, dst and, with weighted, weight) whose nodes have one or two sides."""

    def __init__(self, edges: DataFrame, directed: bool = True, weighted: bool = False):
        self.sides, self.weighted = ("out", "in") if directed else ("any",), weighted
        w = F.sum(F.col("weight").cast("double") if weighted else F.lit(1.0)).alias("w")
        e = edges.filter("src <> dst")
        if weighted:
            e = e.filter("weight > 0")
        out = e.groupBy("src", "dst").agg(w) if directed else e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *(["weight"] if weighted else [])).groupBy("src", "dst").agg(w)
        half = lambda a, b, side: out.select(F.col(a).alias("node"), F.col(b).alias("neighbor"), F.lit(side).alias("side"), "w")
        rows = half("src", "dst", "out").union(half("dst", "src", "in")) if directed else half("src", "dst", "any").union(half("dst", "src", "any"))
        rows = written(rows, "sides")
        mean = rows.groupBy("node", "side").agg(F.avg("w").alias("mean"))
        rows = rows.join(mean, ["node", "side"]).withColumn("w", F.col("w") / F.col("mean"))
        on = lambda s, v: F.sum(F.when(F.col("side") == s, v).otherwise(0))
        per = [f(s) for s in self.sides for f in (lambda s: on(s, F.lit(1)).alias(f"x_{s}"), lambda s: on(s, F.col("w")).cast("double").alias(f"w_{s}"))]
        links = rows.groupBy("node", "neighbor").agg(*per)
        self.links = written(links.select(F.lit(0).cast("long").alias("g"), "*"), "sided-links")
        self.degrees = written(self.links.groupBy("g", "node").agg(*[F.sum(f"x_{s}").alias(f"k_{s}") for s in self.sides]), "sided-degrees")
        self.totals = self.degrees.groupBy("g").agg(*[F.sum(f"k_{s}").alias(f"all_{s}") for s in self.sides], F.count("*").alias("dim"))

    def scored(self, core: DataFrame, members: DataFrame) -> DataFrame:
        """All that touches a core (g, c, node): on each side s its links k_s, those to the core x_s and their weight w_s, and the core's
        free stubs that they may take, free_s, of total_s."""
        names = [f"{a}_{s}" for s in self.sides for a in "xw"]
        touch = self.links.join(core.withColumnRenamed("node", "neighbor"), ["g", "neighbor"]).groupBy("g", "c", "node").agg(*[F.sum(n).alias(n) for n in names])
        rows = touch.join(core.withColumn("inside", F.lit(True)), ["g", "c", "node"], "full").na.fill(dict.fromkeys(names, 0) | {"inside": False})
        rows = rows.join(members.withColumn("member", F.lit(True)), ["g", "c", "node"], "left").na.fill({"member": False}).join(self.degrees, ["g", "node"])
        inside = F.when(F.col("inside"), 1).otherwise(0)
        sums = rows.groupBy("g", "c").agg(F.sum(inside).alias("size"), *[F.sum(inside * F.col(f"{a}_{s}")).alias(f"{a}{a}_{s}") for s in self.sides for a in "kx"])
        free = [(F.col(f"kk_{OTHER[s]}") - F.col(f"xx_{OTHER[s]}")).alias(f"free_{s}") for s in self.sides]
        total = [(F.col(f"all_{s}") - F.col(f"kk_{s}")).alias(f"total_{s}") for s in self.sides]
        sums = sums.join(self.totals, "g").select("g", "c", "size", (F.col("dim") - F.col("size")).alias("outside"), *free, *total)
        return rows.join(sums, ["g", "c"]).filter("outside > 0")

    def _score(self, inside: bool, at: float) -> Column:
        sides, weighted = self.sides, self.weighted

        @F.pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            parts = []
            for s in sides:
                x, k, free, total = (rows[f"{a}_{s}"].to_numpy(np.float64) for a in ("x", "k", "free", "total"))
                if inside:  # as if the node were not of the module
                    free = free - rows[f"k_{OTHER[s]}"].to_numpy() + x + rows[f"x_{OTHER[s]}"].to_numpy()
                    total = total + k
                heavy = gamma_tail(x, rows[f"w_{s}"].to_numpy()) if weighted else np.ones(len(x))
                parts.append((*hypergeometric(x, k, free, total), heavy))
            return pd.Series(np.round(together(parts, [at] * len(parts), weighted), 15))

        return score(F.struct(*[f"{a}_{s}" for s in sides for a in ("x", "w", "k", "free", "total")]))

    def outer(self, rows: DataFrame) -> DataFrame:
        """(g, c, node, outside, tail, parts): tail is the lowest score that can be drawn."""
        sides, weighted = self.sides, self.weighted

        @F.pandas_udf("array<double>")
        def parts(rows: pd.DataFrame) -> pd.Series:
            out = []
            for s in sides:
                x, k, free, total = (rows[f"{a}_{s}"].to_numpy(np.float64) for a in ("x", "k", "free", "total"))
                out += [*hypergeometric(x, k, free, total), gamma_tail(x, rows[f"w_{s}"].to_numpy()) if weighted else np.ones(len(x))]
            return pd.Series(list(np.stack(out, 1)))

        rows = rows.withColumn("parts", parts(F.struct(*[f"{a}_{s}" for s in sides for a in ("x", "w", "k", "free", "total")])))
        return rows.withColumn("tail", self._score(False, 0.0)).select("g", "c", "node", "outside", "tail", "parts")

    def drawn(self, seed: int) -> Column:
        weighted = self.weighted

        @F.pandas_udf("double")
        def score(c: pd.Series, node: pd.Series, run: pd.Series, parts: pd.Series) -> pd.Series:
            p = np.stack(parts.to_numpy()) if len(parts) else np.zeros((0, 3))
            n = p.shape[1] // 3
            u = [draws(seed * 2 + i, c.to_numpy(), node.to_numpy(), run.to_numpy()) for i in range(n)]
            return pd.Series(together([tuple(p[:, 3 * i : 3 * i + 3].T) for i in range(n)], u, weighted))

        return score("c", "node", "run", "parts")

    def weak(self) -> Column:
        return self._score(True, 0.5)


def border_scores(model: Sided, core: DataFrame) -> DataFrame:
    """(g, c, node, links and stubs of each side, score) of the nodes outside that touch a module; scores in the middle of the mass."""
    rows = model.scored(core, core).filter("not inside").withColumn("score", model._score(False, 0.5))
    return rows.select("g", "c", "node", *[f"{a}_{s}" for s in model.sides for a in ("k", "x", "free", "total")], "outside", "score")


def significant(edges: DataFrame, directed: bool = True, weighted: bool = False, mode: str = "both", seed: int = 0, rounds: int = 3, **options) -> DataFrame:  # noqa: ANN003
    """(c, node, score): significant modules of a directed or weighted graph (src, dst, weight).

    Groups under the null model of links, whatever their direction, are cleaned by the scores of sides; nodes that no module took are
    grouped and cleaned again, at most rounds times; of equal and similar modules the best stays.
    """
    model = Sided(edges, directed, weighted)
    left, found = model.links.select("g", "node", "neighbor"), []
    for i in range(rounds):
        groups = modules.label_groups(network(left), seed=seed + i)
        now = clean_up(model, groups, mode, seed=seed + i, **options)
        if not now.limit(1).count():
            break
        found.append(now.select(F.lit(i).alias("i"), "c", "node", "score"))
        taken = written(now.select("node").distinct(), "taken")
        left = written(left.join(taken, "node", "left_anti").join(taken.toDF("neighbor"), "neighbor", "left_anti").select("g", "node", "neighbor"), "left-links")
        if not left.limit(1).count():
            break
    if not found:
        return edges.sparkSession.createDataFrame([], "c long, node long, score double")
    pooled = reduce(DataFrame.union, found)
    ids = numbered(pooled.select("i", "c").distinct(), "i", "c", name="id", first=0)
    pooled = written(modules.distinct_modules(pooled.join(ids, ["i", "c"]).select(F.lit(0).cast("long").alias("g"), F.col("id").alias("c"), "node", "score")).select("c", "node", "score"), "sided-pooled")
    stay = covers.suppress(pooled.select("c", "node"), pooled.groupBy("c").agg(F.max("score").alias("score")))
    return written(pooled.join(stay, ["c", "node"], "left_semi"), "sided-modules")
