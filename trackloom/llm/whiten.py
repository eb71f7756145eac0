"""Embedding whitening by a bidiagonal qd solver.

The different vectors are centred, and a blockwise QR reduces them to one triangle R with the same singular values: every
partition folds its rows block by block, and triangles are folded sixteen at a time until one is left. Householder reflections
make R bidiagonal; dqds finds the squares of its singular values to high relative accuracy; twisted factorisations of the
tridiagonal product give the vectors of the largest ones, which the reflections carry back. Only the triangle of d x d numbers
and sums of d numbers reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.plans.session import settle

#: Rows that are folded into a triangle at once, and triangles that one task folds.
BLOCK_ROWS, FAN_IN = 4096, 16
_EPS = float(np.finfo(np.float64).eps)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B, and W, where ``r`` = U B W' with orthogonal U and W, by Householder reflections."""
    a = np.array(r, np.float64)
    d = a.shape[1]
    w = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0:
            return None
        v = x.copy()
        v[0] += size if x[0] >= 0 else -size
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < d:
            v = reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One differential qd step with a shift; None if the shift is beyond the smallest value."""
    n = len(q)
    q2, e2 = np.empty(n), np.empty(n - 1)
    d = least = q[0] - shift
    for k in range(n - 1):
        if d < 0:
            return None
        q2[k] = d + e[k]
        if q2[k] == 0:
            e2[k], d = 0.0, q[k + 1] - shift
        else:
            t = q[k + 1] / q2[k]
            e2[k] = e[k] * t
            d = d * t - shift
        least = min(least, d)
    if d < 0:
        return None
    q2[-1] = d
    return q2, e2, least


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling; by the differential qd algorithm with shifts."""
    scale = max([1e-300, *np.abs(diagonal), *np.abs(upper)])
    out: list[float] = []
    blocks = [((np.asarray(diagonal, float) / scale) ** 2, (np.asarray(upper, float) / scale) ** 2, 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        for _ in range(100 * len(q) + 100):
            if len(q) < 2:
                break
            # a coupling that no longer changes its neighbours is dropped, which parts the matrix
            free = np.flatnonzero(e <= (_EPS * _EPS) * (moved + np.minimum(q[:-1], q[1:])))
            if len(free):
                cut = int(free[-1]) + 1
                blocks.append((q[:cut], e[: cut - 1], moved))
                q, e = q[cut:], e[cut:]
                continue
            if q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            # the smaller value of the last two rows is near the smallest of all, seldom below it
            a, b, c = q[-2] + e[-1], q[-1], q[-1] * e[-1]
            middle = (a + b) / 2
            shift = max(0.0, (a * b - c) / (middle + np.hypot((a - b) / 2, np.sqrt(c))))
            step = None
            for part in (1 - 1e-3, 0.75, 0.25, 0.0):
                step = _sweep(q, e, shift * part)
                if step is not None:
                    moved += shift * part
                    break
            q, e = step[0], step[1]
        else:
            raise RuntimeError("dqds does not settle")
        out += [moved + x for x in q]
    return np.sort(np.maximum(out, 0.0))[::-1] * scale * scale


def twisted_vector(main: np.ndarray, side: np.ndarray, value: float, start: np.ndarray | None = None) -> np.ndarray:
    """A vector z with (T - value) z nearly 0, of a symmetric tridiagonal T; unit length.

    T - value is factorised from the top and from the bottom, and both are joined in the row where the pivot is smallest. With
    ``start`` one step of inverse iteration from it is made instead.
    """
    n = len(main)
    tiny = _EPS * max(np.abs(main).max(initial=0), np.abs(side).max(initial=0), 1e-300)
    keep = lambda x: x if abs(x) > tiny else (tiny if x >= 0 else -tiny)
    down, up = np.empty(n), np.empty(n)
    down[0] = keep(main[0] - value)
    for i in range(1, n):
        down[i] = keep(main[i] - value - side[i - 1] ** 2 / down[i - 1])
    if start is not None:
        y = np.array(start, float)
        for i in range(1, n):
            y[i] -= side[i - 1] / down[i - 1] * y[i - 1]
        y /= down
        for i in range(n - 2, -1, -1):
            y[i] -= side[i] / down[i] * y[i + 1]
        return y / np.linalg.norm(y)
    up[-1] = keep(main[-1] - value)
    for i in range(n - 2, -1, -1):
        up[i] = keep(main[i] - value - side[i] ** 2 / up[i + 1])
    twist = int(np.argmin(np.abs(down + up - (main - value))))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -side[i] / down[i] * z[i + 1]
    for i in range(twist + 1, n):
        z[i] = -side[i - 1] / up[i] * z[i - 1]
    return z / np.linalg.norm(z)


def principal_axes(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``count`` largest squared singular values of a triangle, their right vectors as columns, and the sum of all squares.

    Vectors of equal values are an orthonormal basis of their space. Values that are 0 beside the largest have no vector.
    """
    diagonal, upper, w = bidiagonalise(r)
    values = dqds(diagonal, upper)
    d = len(values)
    kept = [x for x in values[:count] if x > d * _EPS * values[0]]
    main = diagonal**2
    main[1:] += upper**2
    side = diagonal[:-1] * upper
    found: list[np.ndarray] = []
    for value in kept:
        z = twisted_vector(main, side, value)
        for _ in range(4):
            rest = z - sum(((f @ z) * f for f in found), np.zeros(d))
            if np.linalg.norm(rest) > 0.9:
                z = rest / np.linalg.norm(rest)
                break
            # the space of an equal value is partly used: start again from what is left of a unit vector
            left = np.eye(d) - sum((np.outer(f, f) for f in found), np.zeros((d, d)))
            z = left[np.argmax(np.linalg.norm(left, axis=1))]
            for _ in range(3):
                z = twisted_vector(main, side, value, z)
                z = z - sum(((f @ z) * f for f in found), np.zeros(d))
                z /= np.linalg.norm(z)
        found.append(z)
    axes = w @ np.array(found).T if found else np.empty((d, 0))
    return np.array(kept), axes, float((np.asarray(r) ** 2).sum())


def fold_rows(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangle of the rows below a triangle; d x d, filled up with zeros."""
    whole = rows if r is None else np.vstack([r, rows])
    d = whole.shape[1]
    made = np.linalg.qr(whole, mode="r")
    return made if len(made) == d else np.vstack([made, np.zeros((d - len(made), d))])


@dataclass(frozen=True)
class Whitening:
    """n vectors of dimension d with sums S; unit axes as columns, the variances along them, and that of all dimensions."""

    n: int
    sums: tuple[int, ...]
    variances: np.ndarray
    axes: np.ndarray
    total: float

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """x - S / n, the difference taken in whole numbers where they fit."""
        return self.spread(rows).astype(np.float64) / self.n

    def spread(self, rows: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        sums = np.array(self.sums, object)
        most = int(np.abs(rows).max(initial=0)) * self.n + max((abs(s) for s in self.sums), default=0)
        if most * most * max(1, len(self.sums)) < 1 << 63:
            return rows * self.n - sums.astype(np.int64)
        return rows.astype(object) * self.n - sums

    def project(self, rows: np.ndarray) -> np.ndarray:
        return self.centred(rows) @ self.axes / np.sqrt(self.variances)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every entry, as BIGINT; null if the vector or an entry is null or not finite."""
    entry = F.transform(vector, lambda c: c.cast("double"))
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    fine = F.forall(entry, lambda c: F.coalesce(good(c), F.lit(False)))
    return F.when(fine & (F.size(entry) > 0), F.transform(entry, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint")))


def _matrix(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows whose vectors have the length that most have, the longest of equally many; and that length."""
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = sizes.agg(F.max(F.struct("n", "d"))["d"]).first()[0]
    return (rows, 0) if best is None else (rows.where(F.size("x") == best), best)


def column_sums(vectors: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and the exact sums of their entries; d partial sums a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            # halves, so that no partial sum leaves 64 bits
            rows = _matrix(batch, 0, d)
            high, low = (rows >> 32).sum(axis=0).tolist(), (rows & 0xFFFFFFFF).sum(axis=0).tolist()
            sums = [s + (h << 32) + x for s, h, x in zip(sums, high, low, strict=True)]
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(d), -1], pa.int32()), pa.array([*map(str, sums), str(n)], pa.string())], names=["at", "part"]
        )

    parts = vectors.select("x").mapInArrow(run, "at int, part string").groupBy("at")
    found = dict(parts.agg(F.sum(F.col("part").cast("decimal(38,0)"))).collect())
    return int(found.get(-1, 0)), tuple(int(found.get(i, 0)) for i in range(d))


def _triangles(of: Whitening, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for batch in batches:
            rows = of.centred(_matrix(batch, 0, d))
            for i in range(0, len(rows), BLOCK_ROWS):
                r = fold_rows(r, rows[i : i + BLOCK_ROWS])
        if r is not None:
            part = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([part, pa.array([r.ravel()], pa.list_(pa.float64()))], names=["at", "r"])

    return run


def _folded(d: int):
    def run(part: pa.Table) -> pa.Table:
        r = None
        for row in sorted(part.to_pylist(), key=lambda x: x["at"]):
            r = fold_rows(r, np.array(row["r"]).reshape(d, d))
        at = part.column("at")[0].as_py() // FAN_IN
        return pa.table({"at": pa.array([at], pa.int32()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    return run


def fit_whitening(vectors: DataFrame, d: int, count: int) -> Whitening:
    """Whitening of the different vectors (x ARRAY<BIGINT>) of length d."""
    n, sums = column_sums(vectors, d)
    plain = Whitening(n, sums, np.empty(0), np.empty((d, 0)), 0.0)
    kind = "at int, r array<double>"
    parts = settle(vectors.select("x").mapInArrow(_triangles(plain, d), kind), "triangles")
    widest = parts.agg(F.max("at")).first()[0] or 0
    while widest:
        grouped = parts.groupBy(F.floor(F.col("at") / FAN_IN).alias("grp"))
        parts, widest = settle(grouped.applyInArrow(_folded(d), kind), "triangles"), widest // FAN_IN
    r = np.array(parts.first()["r"]).reshape(d, d)
    squares, axes, total = principal_axes(r, count)
    return Whitening(n, sums, squares / n, axes, total / n)


def identity_error(vectors: DataFrame, of: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors less the identity; centred before multiplying."""
    d, k = of.axes.shape
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = of.project(_matrix(batch, 0, d))
            m, own = len(w), w.mean(axis=0) if len(w) else mean
            if not m:
                continue
            apart = own - mean
            square += (w - own).T @ (w - own) + np.outer(apart, apart) * (n * m / (n + m))
            mean, n = mean + apart * (m / (n + m)), n + m
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([mean], pa.list_(pa.float64())), pa.array([square.ravel()], pa.list_(pa.float64()))],
                names=["n", "mean", "square"],
            )

    parts = vectors.select("x").mapInArrow(run, "n bigint, mean array<double>, square array<double>")
    parts = settle(parts, "whitened-moments")
    share = F.col("n").cast("double")
    weighed = [F.sum(share * F.col("mean")[i]).alias(f"m{i}") for i in range(k)]
    first = parts.agg(F.sum("n").alias("n"), *weighed).first()
    mean = [first[f"m{i}"] / first["n"] for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(k)]
    moved = [
        F.sum(F.col("square")[i * k + j] + share * (F.col("mean")[i] - mean[i]) * (F.col("mean")[j] - mean[j])).alias(f"c{i}_{j}")
        for i, j in cells
    ]
    row = parts.agg(*moved).first()
    return max(abs(row[f"c{i}_{j}"] / first["n"] - (i == j)) for i, j in cells)


def whiten(
    embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", count: int = 4, scale: int = 256
) -> DataFrame:
    """One row per row of ``embeddings`` and component: vec_id, component (from 1, by falling variance), n, deviation, whitened,
    explained, identity_error.

    Entries are rounded down to whole numbers x = floor(scale * entry). The fit is on each different x once: n vectors with
    sums S. deviation is the sum of (n x - S)^2, exact, null beyond 64 bits; whitened is x - S / n on the component, over the
    root of its variance; explained is the component's share of the variance; identity_error is one value for all rows. Rows
    whose vector is null, empty or holds null or non-finite entries are left out, and so are vectors of another length than
    most have, which lie in another space. Fewer components are returned if the vectors span fewer; none if all are equal.
    Ids may be null or repeat and have any type. An empty table gives an empty result; other columns are not read.
    """
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), whole_numbers(F.col(vector), scale).alias("x")).where("x is not null")
    rows = settle(rows, "whole-vectors")
    rows, d = _one_length(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not d:
        return embeddings.sparkSession.createDataFrame([], schema)
    vectors = settle(rows.select("x").distinct(), "different-vectors")
    of = fit_whitening(vectors, d, count)
    error, k = identity_error(vectors, of), of.axes.shape[1]
    explained = (of.variances / of.total).tolist() if k else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, 1, d)
            m = batch.num_rows
            apart = of.spread(x)
            deviation = [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(axis=1)]
            where = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(where)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array([of.n] * (m * k), pa.int64()), pa.array(deviation, pa.int64()).take(pa.array(where)),
                    pa.array(of.project(x).ravel(), pa.float64()), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
