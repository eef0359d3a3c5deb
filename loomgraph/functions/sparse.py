"""Distances between the links of one large component, some rows at a time: nothing of the square of its links is ever held.

With degrees d and s = d_u + d_v of a link uv, the line graph's Laplacian is diag(s) less the incidences of links that share a node. By
Woodbury's formula a link's potential is the mean of its ends', weighted by their degrees, in the graph itself when its links weigh d_u d_v / s:
R(e, f) = 1/s_e + 1/s_f + (r_e - r_f)' W+ (r_e - r_f), where r_e holds d_u / s and d_v / s. W is eliminated from nodes of few neighbors on
(trees and chains leave nothing behind); only what is left, where all have many, is inverted as a dense matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CELLS = 1 << 23  #: numbers of a piece of rows
FRONT = 64  #: neighbors from which on nodes are not eliminated but left to the dense rest


class LinkResistances:
    """Effective resistances in the line graph of a connected graph's links (src, dst), which are distinct and no loops."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, front: int = FRONT) -> None:
        nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
        self.u, self.v = ends[: len(src)], ends[len(src) :]
        self.nodes, self.links = len(nodes), len(src)
        degree = np.bincount(ends).astype(float)
        self.s = degree[self.u] + degree[self.v]
        self.degrees = self.s - 2  # in the line graph
        self.a, self.b = degree[self.u] / self.s, degree[self.v] / self.s
        self._eliminate(degree[self.u] * self.b, front)
        self.own = self._own()
        order = np.argsort(ends, kind="stable")
        self._at, self._starts = order % self.links, np.concatenate([[0], np.cumsum(np.bincount(ends))])

    def _eliminate(self, weight: np.ndarray, front: int) -> None:
        """Star to mesh: a node's neighbors are linked by the products of their weights over the node's sum."""
        near: list[dict[int, float]] = [{} for _ in range(self.nodes)]
        for i, j, w in zip(self.u.tolist(), self.v.tolist(), weight.tolist(), strict=True):
            near[i][j] = near[j][i] = near[i].get(j, 0.0) + w
        queues: list[list[int]] = [[] for _ in range(front)]
        for x, n in enumerate(near):
            if len(n) < front:
                queues[len(n)].append(x)
        gone = np.zeros(self.nodes, bool)
        self.steps: list[tuple[int, np.ndarray, np.ndarray, float]] = []
        left, k = self.nodes, 0
        while k < front and left > 1:
            if not queues[k]:
                k += 1
                continue
            x = queues[k].pop()
            if gone[x] or len(near[x]) != k:
                continue
            others, weights = list(near[x]), list(near[x].values())
            total = sum(weights)
            for i in others:
                del near[i][x]
            for p, (i, w) in enumerate(zip(others, weights, strict=True)):
                mine, share = near[i], w / total
                for j, z in zip(others[p + 1 :], weights[p + 1 :], strict=True):
                    mine[j] = near[j][i] = mine.get(j, 0.0) + share * z
            gone[x] = True
            left -= 1
            self.steps.append((x, np.array(others, int), np.array(weights) / total, total))
            near[x] = {}
            for i in others:
                n = len(near[i])
                if n < front:
                    queues[n].append(i)
                    k = min(k, n)
        self.core = np.flatnonzero(~gone)
        place = {int(x): i for i, x in enumerate(self.core)}
        lap = np.zeros((len(self.core), len(self.core)))
        for x, i in place.items():
            for j, w in near[x].items():
                lap[i, place[j]] = -w
        np.fill_diagonal(lap, -lap.sum(1))
        n = len(self.core)
        self.inverse = np.linalg.inv(lap + 1.0 / n) - 1.0 / n

    def _own(self) -> np.ndarray:
        """r_e' W+ r_e of every link: entries of the inverse between nodes that are or became neighbors, the last eliminated first."""
        place = {int(x): i for i, x in enumerate(self.core)}
        known: dict[int, dict[int, float]] = {}
        when = np.full(self.nodes, self.nodes)
        when[[x for x, *_ in self.steps]] = np.arange(len(self.steps))
        diagonal = np.zeros(self.nodes)
        diagonal[self.core] = self.inverse.diagonal()

        def entry(i: int, j: int) -> float:
            if i == j:
                return diagonal[i]
            if when[i] > when[j]:
                i, j = j, i
            return known[i][j] if i in known else self.inverse[place[i], place[j]]

        for x, others, share, total in reversed(self.steps):
            ids = others.tolist()
            among = np.array([[entry(i, j) for j in ids] for i in ids]).reshape(len(ids), len(ids))
            row = share @ among
            known[x] = dict(zip(ids, row.tolist(), strict=True))
            diagonal[x] = 1 / total + row @ share
        cross = np.array([entry(i, j) for i, j in zip(self.u.tolist(), self.v.tolist(), strict=True)])
        return self.a**2 * diagonal[self.u] + self.b**2 * diagonal[self.v] + 2 * self.a * self.b * cross

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Resistances from the links at these places to all links."""
        g = np.zeros((self.nodes, len(at)))
        i = np.arange(len(at))
        g[self.u[at], i] = self.a[at]
        g[self.v[at], i] = self.b[at]
        for x, others, share, _ in self.steps:
            g[others] += share[:, None] * g[x]
        g[self.core] = self.inverse @ g[self.core]
        for x, others, share, total in reversed(self.steps):
            g[x] = g[x] / total + share @ g[others]
        r = -2 * (self.a[:, None] * g[self.u] + self.b[:, None] * g[self.v])
        r += (self.own + 1 / self.s)[:, None]
        r += (self.own + 1 / self.s)[at]
        r[at, i] = 0.0
        return r.T

    def adjacent(self, at: int) -> np.ndarray:
        """Places of the links that share a node with the one at this place."""
        found = np.concatenate([self._at[self._starts[x] : self._starts[x + 1]] for x in (self.u[at], self.v[at])])
        return np.unique(found[found != at])

    def adjacency(self, at: np.ndarray) -> np.ndarray:
        """Which links are adjacent to those at these places."""
        out = np.zeros((len(at), self.links), bool)
        for i, x in enumerate(at.tolist()):
            out[i, self.adjacent(x)] = True
        return out


def pieces(n: int, first: int, last: int) -> Iterator[np.ndarray]:
    """Places from first to last in pieces whose rows of n numbers are bounded."""
    step = max(1, CELLS // n)
    for at in range(first, last, step):
        yield np.arange(at, min(at + step, last))


def hop_rows(e1: np.ndarray, e2: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Steps from some nodes to all n over links both ways (places e1, e2), -1 where there is no way: a bit a source, united over neighbors."""
    every = np.arange(n)
    to, of = np.concatenate([e1, e2, every]), np.concatenate([e2, e1, every])
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    first = np.searchsorted(to, np.arange(n + 1))
    seeds = np.zeros((n, len(at)), bool)
    seeds[at, np.arange(len(at))] = True
    reached = np.packbits(seeds, axis=1)
    d = np.where(seeds, 0, -1).astype("int32")
    for k in range(1, n):
        new = np.empty_like(reached)
        for part in range(0, n, 1000):
            end = min(part + 1000, n)
            new[part:end] = np.bitwise_or.reduceat(reached[of[first[part] : first[end]]], first[part:end] - first[part], axis=0)
        if (new == reached).all():
            break
        d[np.unpackbits(new ^ reached, axis=1, count=len(at)).astype(bool)] = k
        reached = new
    return d.T
