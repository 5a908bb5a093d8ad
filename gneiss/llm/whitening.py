"""Embedding whitening by spectral divide-and-conquer.

Spark sums the vectors and their centred products; the covariance, as large as the square of the dimension, is split on the driver:
the polar factor of the shifted covariance, found by QR-based dynamically weighted Halley iterations, gives the projector on the
components above the shift, and both invariant subspaces are split in turn until single components are left. Mean and leading
components go to the tasks, which whiten each vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries beyond this, scaled, count as it: sums stay exact.
MOST = float(1 << 40)
EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its sign. It has not converged where an eigenvalue is next to zero."""
    m = len(a)
    x, low = a / max(np.linalg.norm(a), 1e-300), EPS / m
    for _ in range(12):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        root = np.sqrt(1 + d)
        p = root + np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * root)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(m)]))[0]
        new = q / r * x + (p - q / r) / np.sqrt(r) * both[:m] @ both[m:].T
        new, low = (new + new.T) / 2, min(1.0, low * (p + q * l2) / (1 + r * l2))
        moved = np.linalg.norm(new - x)
        x = new
        if abs(1 - low) < 10 * EPS and moved < 1e-9:
            break
    return x


def _halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the components of ``a`` above a shift, and how many they are; None if all are equal."""
    m = len(a)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m))
    if spread <= EPS * scale * m:
        return None
    best = None
    rng = np.random.default_rng(m)
    # the mean lies between the least and the greatest; it is moved where it meets a component
    for shift in [np.median(np.diag(a)), mean, *(mean + spread * t / m for t in (0.1, -0.1, 0.3, -0.3, 0.5, -0.5))]:
        u = polar(a - shift * np.eye(m))
        above = (u + np.eye(m)) / 2
        k = int(round(np.trace(above)))
        if not 0 < k < m:
            continue
        q = np.hstack([above @ rng.standard_normal((m, k)), rng.standard_normal((m, m - k)) - above @ rng.standard_normal((m, m - k))])
        for _ in range(2):
            q = np.linalg.qr(np.hstack([above @ q[:, :k], q[:, k:] - above @ q[:, k:]]))[0]
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = left, q, k
        if left <= 10 * EPS * scale * m:
            break
    return best and best[1:]


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns."""
    a = (a + a.T) / 2
    m, scale = len(a), np.linalg.norm(a)
    vectors, todo = np.eye(m), [(0, m)]
    while todo:
        at, to = todo.pop()
        own = vectors[:, at:to]
        part = own.T @ a @ own
        if to - at > 1 and (found := _halves((part + part.T) / 2, scale)):
            q, k = found
            vectors[:, at:to] = own @ q
            todo += [(at, at + k), (at + k, to)]
    # what rounding left between components is taken out by first-order corrections, to second order in each step
    for _ in range(3):
        r, s = np.eye(m) - vectors.T @ vectors, vectors.T @ a @ vectors
        e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        near = np.abs(gap) <= 2 * (np.linalg.norm(s - np.diag(e)) + scale * np.linalg.norm(r))
        vectors = vectors + vectors @ np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1.0, gap))
    for _ in range(2):
        vectors = vectors @ (1.5 * np.eye(m) - vectors.T @ vectors / 2)
    e = np.einsum("ij,ij->j", vectors, a @ vectors) / np.einsum("ij,ij->j", vectors, vectors)
    order = np.argsort(-e, kind="stable")
    return e[order], (vectors / np.linalg.norm(vectors, axis=0))[:, order]


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray  # of whole numbers, exact
    values: np.ndarray  # of all components, falling
    weights: np.ndarray  # a column for each leading component, divided by its deviation
    rest: np.ndarray  # mean of the whitened vectors, next to zero
    identity_error: float


def _whole(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and floor(1024 * c) + 100000 of their entries, for vectors of ``size`` entries."""
    lens = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(np.maximum(lens, 0)) - np.maximum(lens, 0)
    rows = np.flatnonzero(lens == size)
    x = flat[start[rows][:, None] + np.arange(size)]
    good = np.isfinite(x).all(1)
    return rows[good], np.clip(np.floor(x[good] * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def _far(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: in whole numbers of any size where longs don't hold it."""
    return n * (x.astype(object) if n * int(np.abs(x).max(initial=0)) >= 1 << 62 else x) - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, each difference rounded once."""
    return (_far(x, n, sums) / n).astype(np.float64)


def _sized(vectors: pa.Array) -> list[int]:
    return [int(k) for k in np.unique(vectors.value_lengths().drop_null().to_numpy()) if k > 0]


def _products(vectors: DataFrame, size: int, columns: int, each) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of outer products of ``each`` (an array of ``columns`` columns from whole numbers), added up over tasks by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(columns), np.zeros((columns, columns))
        for b in batches:
            y = each(_whole(b.column(0), size)[1])
            total, square = total + y.sum(0), square + y.T @ y
        for i in range(columns):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([[total[i], *square[i, i:]]], pa.list_(pa.float64()))], names=["i", "v"])

    parts = vectors.mapInArrow(add, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    total, square = np.zeros(columns), np.zeros((columns, columns))
    # a row for each pair of dimensions
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        if r["j"] == 0:
            total[r["i"]] = r["v"]
        else:
            square[r["i"], r["i"] + r["j"] - 1] = square[r["i"] + r["j"] - 1, r["i"]] = r["v"]
    return total, square


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Mean, spectrum and leading components of all vectors that take part; None if there is none.

    Vectors that are null or hold null or non-finite entries don't take part, nor do those that are shorter than the longest (what they
    lack is null), nor empty ones. A component whose variance is zero, but for rounding, has zero weights.
    """
    vectors = rows.select(F.col(column).cast("array<double>").alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size in _sized(b.column(0)):
                x = _whole(b.column(0), size)[1]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.sum(0).tolist()], pa.list_(pa.int64()))], names=["size", "n", "v"])

    sums = vectors.mapInArrow(add, "size int, n long, v array<long>")
    sums = sums.groupBy("size", F.lit(-1).alias("i")).agg(F.sum("n").cast("decimal(38,0)").alias("v")).unionByName(sums.select("size", F.posexplode("v").alias("i", "v")).groupBy("size", "i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")))
    found = sums.groupBy("size").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("v")).orderBy(F.desc("size")).first()  # a row for each dimension
    if found is None:
        return None
    size, n = found["size"], int(found["v"][-1])
    total = np.array([int(found["v"][i]) for i in range(size)])
    _, square = _products(vectors, size, size, lambda x: _centred(x, n, total))
    values, basis = spectrum(square / n)
    values = np.maximum(values, 0.0)
    k = min(components, size)
    alive = values[:k] > size * EPS * max(values[0], 1e-300)
    weights = basis[:, :k] * np.where(alive, 1 / np.sqrt(np.where(alive, values[:k], 1.0)), 0.0)
    middle, _ = _products(vectors, size, k, lambda x: _centred(x, n, total) @ weights)
    middle = middle / n
    _, square = _products(vectors, size, k, lambda x: _centred(x, n, total) @ weights - middle)
    off = np.abs(square / n - np.eye(k))[np.ix_(alive, alive)]
    return Whitening(n, total, values, weights, middle, float(off.max()) if off.size else 0.0)


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each vector that takes part and each leading component.

    Repeated rows and null ids are rows like others; an empty table, or one without a vector that takes part, gives an empty one. deviation,
    the sum of (n * x - S) ** 2, is null where it exceeds a long. Where a component has no variance, whitened is 0, and
    identity_error leaves it out; explained is 0 where there is no variance at all.
    """
    model = fit(rows, column, components)
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    if model is None:
        return ids.sparkSession.createDataFrame([], OUT)
    size, k = model.weights.shape
    trace = model.values.sum()
    share = model.values[:k] / trace if trace > 0 else np.zeros(k)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, x = _whole(b.column(1), size)
            if not len(own):
                continue
            far = _far(x, model.n, model.sums)
            rough = (far.astype(np.float64) ** 2).sum(1)
            exact = (far * far).sum(1).tolist()
            for i in np.flatnonzero(rough > 2.0**62):
                d = sum(int(f) ** 2 for f in far[i])
                exact[i] = d if d < 1 << 63 else None
            out = _centred(x, model.n, model.sums) @ model.weights
            m = len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(own, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(exact, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(out.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error)),
                ],
                names=[f.split()[0] for f in OUT.split(", ")],
            )

    return ids.mapInArrow(put, OUT)
