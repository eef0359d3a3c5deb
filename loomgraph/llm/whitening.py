"""Whitening of embeddings by a blockwise TSQR and a one-sided Jacobi SVD.

Entries are put on a grid of integers, so that sums and deviations are exact whatever the order of rows. Each task centres its
rows and reduces them, block by block, to a triangle R by QR; triangles of a few tasks at a time are stacked and reduced again
until one is left, whose R'R is that of all centred rows. Covariances are never formed, so small deviations keep their digits. Plane
rotations then orthogonalise R's columns, disjoint planes at once, in sweeps until no pair of columns is off a right angle; the
accumulated rotations are the components and the columns' lengths over sqrt(n) the standard deviations.

Scale: three passes over the vectors (sums, triangles, covariance of the result) and the pass that writes; a task sends d numbers,
a triangle of d * d, and components ** 2 numbers. Triangles meet in groups of at most ``FAN_BYTES``. What the driver holds is one
triangle, bounded by the dimensions and not by the rows.

Defined cases: vectors that are null, hold a null or a non-finite value, or whose length is not the table's most frequent one
(ties: the shortest) are dropped, as are empty ones; copies and repeated rows count each; a null vec_id stays null; components
without variance, to rounding, can't be whitened and are left out, so one vector, or only equal ones, give no rows; entries beyond
2^44 in size are put at that bound; a deviation beyond a long is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import written

SCALE, SHIFT = 64, 1_000_000
MOST = 2.0**44
ROWS = 4096  #: rows that are reduced at a time
FAN_BYTES = 1 << 26  #: of triangles that meet in a group


@dataclass
class Whitening:
    """What a fit found: components are columns, by falling variance."""

    n: int
    sums: np.ndarray  # exact sums of the grid's integers, as Python integers
    components: np.ndarray
    variances: np.ndarray
    trace: float


def on_grid(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x (array of long) of the vectors that take part."""
    vec = F.col(column).cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = vectors.select("vec_id", vec.alias("v")).filter(F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & finite, F.lit(False)))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    place = lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-MOST)), F.lit(MOST))) + shift
    return good.filter(F.size("v") == d).select("vec_id", F.transform("v", place).alias("x"))


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of at most ROWS rows, as integers, and where they begin."""
    for at in range(0, len(batch), ROWS):
        part = batch.column("x").slice(at, ROWS)
        yield at, part.flatten().to_numpy().reshape(len(part), -1)


def exact_sums(grid: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for _, x in _matrix(batch):
                here = x.sum(0).astype(object)
                n, total = n + len(x), here if total is None else total + here
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array([-1, *range(len(total))], pa.int32()), "s": pa.array([str(v) for v in [n, *total]])})

    partial = grid.select("x").mapInArrow(run, "dim int, s string")
    rows = sorted(partial.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect())
    return (int(rows[0][1]), np.array([int(r[1]) for r in rows[1:]], object)) if rows else (0, np.zeros(0, object))


def _off(n: int, sums: np.ndarray, x: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: as longs where they fit, else as Python integers."""
    most = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums)) if len(x) else 0
    return x * np.int64(n) - sums.astype(np.int64) if most < 2**62 else x.astype(object) * n - sums


def centred(n: int, sums: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x less its mean, from exact integers, so that it is rounded once."""
    return (_off(n, sums, x) / n).astype(np.float64)


def deviations(n: int, sums: np.ndarray, x: np.ndarray) -> list[int | None]:
    """The exact sum of squares of n * x - sums of each row; None beyond a long."""
    off = _off(n, sums, x)
    most = int(np.abs(off).max()) if off.size else 0
    exact = (off * off).sum(1).tolist() if most < 2**31 and most**2 * off.shape[1] < 2**63 else [sum(v * v for v in row) for row in off.tolist()]
    return [v if v < 2**63 else None for v in exact]


def triangle(*blocks: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of blocks stacked, d by d."""
    r = np.linalg.qr(np.vstack(blocks), mode="r")
    return np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))]) if len(r) < r.shape[1] else r


def _packed(r: np.ndarray) -> bytes:
    return r.astype("<f8").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw, "<f8")
    return flat.reshape(int(round(len(flat) ** 0.5)), -1)


def tsqr(grid: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """The triangle of all centred rows: a triangle a task, then trees of small groups."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for _, x in _matrix(batch):
                c = centred(n, sums, x)
                r = triangle(c) if r is None else triangle(r, c)
        if r is not None:
            yield pa.RecordBatch.from_pydict({"r": pa.array([_packed(r)], pa.binary())})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [_packed(triangle(*map(_unpacked, rows["r"])))]})

    fan = min(max(2, FAN_BYTES // (8 * len(sums) ** 2)), 64)
    level = written(grid.select("x").mapInArrow(local, "r binary").withColumn("at", F.monotonically_increasing_id()), "triangles")
    while (left := level.count()) > 1:
        groups = -(-left // fan)
        dealt = level.select(F.pmod(F.xxhash64("at"), F.lit(groups)).alias("g"), "r") if groups > 1 else level.select(F.lit(0).alias("g"), "r")
        level = written(dealt.groupBy("g").applyInPandas(merged, "r binary").withColumn("at", F.monotonically_increasing_id()), "triangles")
    return _unpacked(level.first()["r"])


def rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A sweep over all pairs of columns as rounds of disjoint pairs (a round-robin tournament)."""
    seats = list(range(d + d % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[:half - 1 : -1], strict=True) if max(p, q) < d]
        yield tuple(np.array(pairs, int).reshape(-1, 2).T)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors as columns, by plane rotations of its columns."""
    d = r.shape[1]
    size = np.abs(r).max(initial=0.0)
    a, v = (r / size if size else r).T.copy(), np.eye(d)  # a row is a column of r
    plan, tol = list(rounds(d)), 4 * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p, q in plan:
            x, y = a[p], a[q]
            alpha, beta, gamma = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            on = np.flatnonzero(np.abs(gamma) > tol * np.sqrt(alpha * beta))
            if not len(on):
                continue
            turned = True
            p, q, alpha, beta, gamma = p[on], q[on], alpha[on], beta[on], gamma[on]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = (1 / np.hypot(1.0, t))[:, None]
            s = c * t[:, None]
            a[p], a[q] = c * a[p] - s * a[q], s * a[p] + c * a[q]
            v[p], v[q] = c * v[p] - s * v[q], s * v[p] + c * v[q]
        if not turned:
            break
    lengths = np.sqrt((a * a).sum(1))
    order = np.argsort(-lengths, kind="stable")
    v = v[order]
    return lengths[order] * size, (v / np.sqrt((v * v).sum(1))[:, None]).T


def fit(grid: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of a grid of vectors; None for no vectors."""
    n, sums = exact_sums(grid)
    if not n:
        return None
    lengths, v = jacobi(tsqr(grid, n, sums))
    some = lengths > lengths[0] * 16 * len(sums) * np.finfo(float).eps
    kept = np.flatnonzero(some)[:components]
    return Whitening(n, sums, v[:, kept], lengths[kept] ** 2 / n, float((lengths**2).sum() / n))


def identity_error(grid: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity."""
    k = model.components.shape[1]
    onto = model.components / np.sqrt(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for _, x in _matrix(batch):
                y = centred(model.n, model.sums, x) @ onto
                gram += y.T @ y / model.n
                mean += y.sum(0) / model.n
        both = np.concatenate([gram.ravel(), mean])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(both))), "s": pa.array(both)})

    rows = grid.select("x").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas().sort_values("i")["s"].to_numpy()
    gram, mean = rows[: k * k].reshape(k, k), rows[k * k :]
    return float(np.abs(gram - np.outer(mean, mean) - np.eye(k)).max())


def transform(grid: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, deviation, whitened: a row for each vector and component."""
    k = model.components.shape[1]
    onto = model.components / np.sqrt(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrix(batch):
                y = centred(model.n, model.sums, x) @ onto
                rows = pa.array(np.repeat(np.arange(len(x)), k))
                exact = pa.array(deviations(model.n, model.sums, x), pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {"vec_id": batch.column("vec_id").slice(at, len(x)).take(rows), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), "deviation": exact.take(rows), "whitened": pa.array(y.ravel())}
                )

    kind = grid.schema["vec_id"].dataType.simpleString()
    return grid.mapInArrow(run, f"vec_id {kind}, component int, deviation long, whitened double")


def whitened(vectors: DataFrame, components: int = 32, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and component up to that number."""
    grid = on_grid(vectors.select(F.col("vec_id").cast("long"), column), column)
    model = fit(grid, components)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.variances])
    out = transform(grid, model)
    return out.select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"), F.lit(identity_error(grid, model)).alias("identity_error"),
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
