"""Dense linear algebra by connected block, as grouped NumPy kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.sparse import pieces
from loomgraph.functions.storage import spread

ROWS = 500_000  #: rows of pairs that a kernel hands on at once
CHUNK = 4_096  #: nodes of a large component whose rows a task makes


def pseudo_inverse(a: np.ndarray, rcond: float | None = None) -> np.ndarray | None:
    """Moore-Penrose inverse by singular values; those below max(shape) s1 2e-16 (or rcond s1) count as 0; None if all do."""
    u, s, v = np.linalg.svd(a, full_matrices=False)
    least = s[0] * (max(a.shape) * 2e-16 if rcond is None else rcond)
    keep = (s >= least) & (s > 0)
    return (v[keep].T / s[keep]) @ u[:, keep].T if keep.any() else None


def laplacian_inverse(n: int, i: np.ndarray, j: np.ndarray, method: str = "svd", rcond: float | None = None) -> np.ndarray:
    """The pseudo-inverse of a connected graph's Laplacian; "gamma" inverts L + J/n instead, which is regular."""
    lap = np.zeros((n, n))
    lap[i, j] = lap[j, i] = -1.0
    np.fill_diagonal(lap, -lap.sum(1))
    if n == 1:
        return np.zeros((1, 1))
    if method == "gamma":
        return np.linalg.inv(lap + 1.0 / n) - 1.0 / n
    inv = pseudo_inverse(lap, rcond)
    return np.zeros((n, n)) if inv is None else inv


def resistance_matrix(adjacent: np.ndarray, method: str = "svd", rcond: float | None = None) -> np.ndarray:
    """Effective resistances between the nodes of a connected graph."""
    inv = laplacian_inverse(len(adjacent), *np.nonzero(adjacent), method, rcond)
    own = inv.diagonal()
    return own[:, None] + own[None, :] - 2 * inv


def hops(adjacent: np.ndarray) -> np.ndarray:
    """Steps between the nodes of a graph, -1 where there is no way: sets of reached nodes as bits, united over neighbors."""
    n = len(adjacent)
    near = adjacent | np.eye(n, dtype=bool)
    at, to = np.nonzero(near)
    first = np.searchsorted(at, np.arange(n))
    d = np.where(np.eye(n, dtype=bool), 0, -1).astype("int32")
    reached = np.packbits(np.eye(n, dtype=bool), axis=1)
    for k in range(1, n):
        new = np.empty_like(reached)
        for part in range(0, n, 1000):  # neighbors of a thousand nodes at a time
            end = first[part + 1000] if part + 1000 < n else len(to)
            new[part : part + 1000] = np.bitwise_or.reduceat(reached[to[first[part] : end]], first[part : part + 1000] - first[part], axis=0)
        if (new == reached).all():
            break
        d[np.unpackbits(new ^ reached, axis=1, count=n).astype(bool)] = k
        reached = new
    return d


def block_rows(links: DataFrame, component: DataFrame) -> DataFrame:
    """(component, e1, e2): the links of each component, and its nodes as links to themselves; a row a link, spread for dense kernels."""
    members = component.select("component", F.col("node").alias("e1"), F.col("node").alias("e2"))
    rows = links.join(component.withColumnRenamed("node", "e1"), "e1").select("component", "e1", "e2").union(members)
    return spread(rows, "component")


def block(rows: pd.DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted nodes of a component's rows, and which of them are adjacent."""
    e1, e2 = rows["e1"].to_numpy(), rows["e2"].to_numpy()
    ids = np.sort(e1[e1 == e2])
    if len(ids) > most:
        raise ValueError(f"a component of {len(ids)} nodes; dense blocks have at most {most}")
    adjacent = np.zeros((len(ids), len(ids)), bool)
    i, j = np.searchsorted(ids, e1), np.searchsorted(ids, e2)
    adjacent[i, j] = adjacent[j, i] = True
    np.fill_diagonal(adjacent, False)
    return ids, adjacent


def block_pairs(links: DataFrame, component: DataFrame, value: Callable[[np.ndarray], np.ndarray], pairs: str = "upper", most: int = 20_000) -> DataFrame:
    """(component, e1, e2, d) of a measure within each component; value: from an adjacency matrix to the dense measure, NaN for null.

    links: e1, e2; component: node, component. pairs: "upper" (e1 < e2), "linked" (adjacent, e1 < e2) or "all". Only the links are
    shuffled; the pairs leave their component's task in pieces. A component of more than most nodes is refused rather than cut.
    """

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        ids, adjacent = block(rows, most)
        d = value(adjacent)
        step = max(1, ROWS // len(ids))
        for at in range(0, len(ids), step):
            wanted = np.ones((min(step, len(ids) - at), len(ids)), bool) if pairs == "all" else np.triu(np.ones((min(step, len(ids) - at), len(ids)), bool), at + 1)
            if pairs == "linked":
                wanted &= adjacent[at : at + step]
            i, j = np.nonzero(wanted)
            yield pd.DataFrame({"component": np.full(len(i), rows["component"].iloc[0]), "e1": ids[i + at], "e2": ids[j], "d": d[at : at + step][i, j].astype(float)})

    return block_rows(links, component).groupBy("component").applyInPandas(kernel, "component long, e1 long, e2 long, d double")


def row_pairs(rows: DataFrame, order: str, large: DataFrame, begin: Callable[[pd.DataFrame], tuple[np.ndarray, Callable, Callable]], pairs: str = "upper", chunk: int = CHUNK) -> DataFrame:
    """(component, e1, e2, d) within components too large for a matrix: the rows of up to chunk nodes are a task of their own.

    rows: what a component is made of, with its component; large: component, count (its nodes). begin: from a component's rows, sorted by
    order, to its nodes, the measure of some of them (places) to all, and which of all are adjacent to these.
    """
    parts = large.select("component", "count", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / chunk).cast("int"))).alias("part"))

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames))
        part = int(frame["part"].iloc[0])
        ids, measure, adjacency = begin(frame.sort_values(order))
        n = len(ids)
        for at in pieces(n, part * chunk, min((part + 1) * chunk, n)):
            d = measure(at)
            if pairs == "all":
                wanted = np.ones(d.shape, bool)
            else:
                wanted = np.arange(n) > at[:, None]
                if pairs == "linked":
                    wanted &= adjacency(at)
            step = max(1, ROWS // n)
            for first in range(0, len(at), step):
                i, j = np.nonzero(wanted[first : first + step])
                yield pd.DataFrame({"component": np.full(len(i), frame["component"].iloc[0]), "e1": ids[at[i + first]], "e2": ids[j], "d": d[i + first, j].astype(float)})

    dealt = rows.join(F.broadcast(parts.select("component", "part")), "component")
    return spread(dealt, "component", "part").groupBy("component", "part").applyInPandas(kernel, "component long, e1 long, e2 long, d double")
