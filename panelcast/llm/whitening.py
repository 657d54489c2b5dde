"""Embedding whitening by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import dropped, saved

#: Exact as doubles, and sums of squares of theirs stay in range.
LARGEST = 2.0**53
#: Products with the data that one filter may use, and that all may use.
DEGREE, MOST_PASSES = 12, 600
#: A filter raises the largest eigenvalue over the cut by this factor at most.
GAIN = 1e10


@dataclass
class Fit:
    """A fitted whitening: ``components`` has a unit eigenvector per column."""

    dim: int
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float
    residual: float
    passes: int


def lattice(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, dim, x): every usable vector as longs floor(scale * c), packed in
    the least of 2, 4 and 8 bytes each that holds them all."""

    def run(batches):
        for b in batches:
            v, ids = b.column("v"), b.column("id")
            ends = np.asarray(v.offsets)
            flat = v.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(flat * scale)
            ok = np.abs(x) < LARGEST  # false for NaN
            valid = np.asarray(v.is_valid())
            bad = np.concatenate(([0], np.cumsum(~ok)))
            rows = np.flatnonzero(valid & (ends[1:] > ends[:-1]) & (bad[ends[1:]] == bad[ends[:-1]]))
            out = []
            for i in rows.tolist():
                own = x[ends[i] : ends[i + 1]]
                most = np.abs(own).max()
                out.append(own.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array(np.diff(ends)[rows].astype(np.int32)), pa.array(out, pa.binary())], names=["id", "dim", "x"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"id {kind}, dim int, x binary")


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The longs of packed rows."""
    out = np.zeros((len(column), dim), np.int64)
    packs = column.to_pylist()
    widths = np.fromiter(map(len, packs), np.int64, len(packs)) // dim
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join([packs[i] for i in at.tolist()]), f"<i{width}").reshape(-1, dim)
    return out


def _totals(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many vectors, and their exact sum in every dimension."""

    def run(batches):
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            x = unpacked(b.column("x"), dim)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        cell = np.arange(2 * dim + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate((high, low, [n])))], names=["cell", "s"])

    got = dict(rows.select("x").mapInArrow(run, "cell int, s long").groupBy("cell").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect())
    return int(got.get(2 * dim, 0)), [(int(got.get(j, 0)) << 32) + int(got.get(dim + j, 0)) for j in range(dim)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in doubles, the whole part taken off in integers first."""
    return (x - np.array([s // n for s in sums], np.int64)).astype(float) - np.array([s % n for s in sums]) / n


def _summed(rows: DataFrame, dim: int, shape: tuple[int, int], f) -> np.ndarray:
    """Sum over tasks of the matrices that ``f`` makes of the centred rows of
    a batch.  Cells are added up in a shuffle, so the driver gets one matrix
    whatever the number of tasks."""

    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += f(unpacked(b.column("x"), dim))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "s"])

    out = np.zeros(shape[0] * shape[1])
    for cell, s in rows.select("x").mapInArrow(run, "cell int, s double").groupBy("cell").agg(F.sum("s")).collect():
        out[cell] = s
    return out.reshape(shape)


def _rotated(q: np.ndarray, w: np.ndarray):
    """Rayleigh-Ritz: (values falling, vectors, their products, residuals)."""
    h = q.T @ w
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    values, q, w = values[::-1], q @ turn, w @ turn
    return values, q, w, np.linalg.norm(w - q * values, axis=0)


def leading_eigenpairs(product, dim: int, k: int, block: int, tolerance: float, seed: int = 0):
    """(values, vectors, largest residual over the largest value, products used)
    of the ``k`` largest eigenvalues of a symmetric matrix without negative
    eigenvalues, known by ``product(Q)`` alone.

    A block of vectors is filtered by a Chebyshev polynomial of the matrix
    that stays within 1 on [0, cut] and grows above; then made  (QR) and rotated to its Ritz vectors, until the residuals of the first k
    certify them: |V q - e q| <= tolerance * the largest value.  The cut is the block's least Ritz value, or
    less of it after a filter that gained nothing (as where the block's values are equal).
    """
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((dim, block)))[0]
    passes, best, stalled, share = 0, np.inf, 0, 1.0
    while True:
        values, q, w, residual = _rotated(q, product(q))
        passes += 1
        top = max(values[0], 0.0)
        residual = residual / top if top > 0 else 0 * residual
        worst = residual[:k].max(initial=0.0)
        # Rounding alone keeps residuals up; no more is to be had once filters don't lower them.
        stalled = stalled + 1 if worst > 0.5 * best else 0
        share = share / 2 if stalled else min(1.0, share * 2)
        best = min(best, worst)
        if worst <= tolerance or block == dim or (stalled >= 3 and worst <= 50 * tolerance):
            return values[:k], q[:, :k], worst, passes
        if passes >= MOST_PASSES:
            raise ArithmeticError(f"residual {worst:.1e} after {passes} passes; a wider block may be needed")
        # Vectors that have arrived are kept, and kept out of the filter, so
        # that a large first eigenvalue doesn't drown the others.
        done = min(int(np.argmax(residual > tolerance)), k - 1)
        cut, high = max(values[-1], 0.0) * share, values[done]
        if cut <= 1e-12 * top:  # a plain step gets rid of a null space
            q = np.linalg.qr(w)[0]
            continue
        locked, q, w = q[:, :done], q[:, done:], w[:, done:]

        def apart(x):
            return x - locked @ (locked.T @ x)

        half = cut / 2
        ratio = max((high - half) / half, 1 + 1e-9)
        degree = int(np.clip(np.log(GAIN) / np.arccosh(ratio), 1, DEGREE))
        # T_m of (V - half) / half by its three-term recurrence, scaled by its value at the top.
        sigma = 1 / ratio
        before, now = q, apart(w - half * q) * (sigma / half)
        for _ in range(2, degree + 1):
            after = 1 / (2 * ratio - sigma)
            before, now = now, apart((product(now) - half * now) * (2 * after / half) - before * (sigma * after))
            sigma = after
            passes += 1
        q = np.linalg.qr(np.hstack((locked, now)))[0]


def fit(rows: DataFrame, dim: int, k: int = 16, *, block: int | None = None, tolerance: float = 2e-14) -> Fit | None:
    """Whitening of the packed vectors ``rows`` (x), each counted once: the
    first ``k`` components, fewer where the covariance has a lower rank.  None
    without rows.  Every step is a pass over the rows that adds up a matrix of
    ``dim`` x ``block`` (two blocks of k by default)."""
    n, sums = _totals(rows, dim)
    if not n:
        return None
    k = min(k, dim)
    block = min(dim, max(block or 2 * k, k))

    def product(q):
        def one(x):
            c = _centred(x, n, sums)
            return c.T @ (c @ q)
        return _summed(rows, dim, q.shape, one) / n

    trace = float(_summed(rows, dim, (1, 1), lambda x: np.square(_centred(x, n, sums)).sum().reshape(1, 1))[0, 0]) / n
    values, vectors, worst, passes = leading_eigenpairs(product, dim, k, block, tolerance)
    real = values > max(trace, 0.0) * 1e-13
    values, vectors = values[real], vectors[:, real]
    m = len(values)
    error = 0.0
    if m:
        weights = vectors / np.sqrt(values)

        def moments(x):
            y = _centred(x, n, sums) @ weights
            return np.vstack((y.T @ y, y.sum(0)))
        got = _summed(rows, dim, (m + 1, m), moments) / n
        error = float(np.abs(got[:m] - np.outer(got[m], got[m]) - np.eye(m)).max())
    return Fit(dim, n, sums, values, vectors, values / trace if m else values, error, worst, passes + 3)


def whitened(vectors: DataFrame, *, k: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0,
             block: int | None = None, tolerance: float = 2e-14) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error):
    for each usable vector and component, numbered from 1.

    A vector's entry c becomes the long x = floor(scale * c); a constant added
    to every x would change no result.  Each different x vector counts once in the fit: n of them with the sums S.
    ``deviation`` is the exact sum over dimensions of (n * x - S)^2, null
    where it doesn't fit into a long.  ``whitened`` is x - S / n projected on
    the component, over the root of its eigenvalue; ``explained`` the
    eigenvalue's share of the trace, ``identity_error`` the largest entry of
    the whitened fit list's covariance minus the identity, measured in a pass
    of its own.

    The eigenvectors come from :func:`leading_eigenpairs`: sums of dim x block
    are all that leaves the executors.  Signs are fixed: a component's
    largest entry is positive.

    Vectors that are null, empty, or hold a null, a non-finite entry or one
    whose x is beyond 2^53 are left out, and so are vectors of another length
    than the most common one (the smaller of equally common ones).  Rows that repeat stay, each with its own result.
    Fewer than ``k`` components come out where the covariance has a lower
    rank; none for one single vector; no rows for an empty table.  Other
    columns are ignored.
    """
    rows = saved(lattice(vectors, id_col, vector_col, scale), "lattice")
    dims = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = dims[0]["dim"]
    rows = rows.where(F.col("dim") == dim)
    different = saved(rows.select("x").distinct(), "different")
    got = fit(different, dim, k, block=block, tolerance=tolerance)
    dropped(different)
    n, sums, m = got.n, got.sums, len(got.eigenvalues)
    signs = np.sign(got.components[np.abs(got.components).argmax(0), np.arange(m)]) if m else np.ones(0)
    weights = got.components * signs / np.sqrt(got.eigenvalues)

    def run(batches):
        low, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
        for b in batches:
            x = unpacked(b.column("x"), dim)
            away = x - low
            rough = np.square(away.astype(float) * n - rest).sum(1)
            with np.errstate(over="ignore"):
                exact = np.square(away * n - rest).sum(1)
            deviation = [
                d if r < 2.0**62 else e if (e := sum((int(a) * n - int(s)) ** 2 for a, s in zip(row, rest))) < 1 << 63 else None
                for d, r, row in zip(exact.tolist(), rough.tolist(), away)]
            y = _centred(x, n, sums) @ weights
            size = len(x) * m
            yield pa.RecordBatch.from_arrays([
                b.column("id").take(pa.array(np.repeat(np.arange(len(x)), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, n)), pa.array([d for d in deviation for _ in range(m)], pa.int64()), pa.array(y.ravel()),
                pa.array(np.tile(got.explained, len(x))), pa.array(np.full(size, got.identity_error)),
            ], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(run, schema)
