"""KMeans for many numbers of clusters at once (M9): a pass over the data
serves all of them.

Rows are weighted vectors (``features array<double>, weight``).  A pass sends
every model's centres to the tasks and adds up, per cluster, the weight and
the weighted sum of its rows: the shuffle and the driver see
one row per cluster and dimension, whatever the number of rows.  48 models
take as many passes as the slowest of them, not 48 times as many.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of seeding, and rows that a round adds per cluster asked for.
ROUNDS, OVERSAMPLING = 5, 2


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(batch.column("features").flatten()).reshape(-1, dim)
    return x, np.asarray(batch.column("weight"), float)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centre, the first of equals; squared distance)."""
    far = (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T
    best = far.argmin(1)
    # The distance itself without cancellation: 0 for a row that is a centre.
    return best, np.square(x - centres[best]).sum(1)


def _luck(x: np.ndarray, seed: int, step: int) -> np.ndarray:
    """An exponential draw per row that its content, the seed and the step decide."""
    salt = zlib.crc32(f"{seed}:{step}".encode())
    u = np.array([zlib.crc32(r.tobytes(), salt) for r in x], float)
    return -np.log((u + 0.5) / 2**32)


def candidates(rows: DataFrame, dim: int, k: int, seed: int) -> np.ndarray:
    """Rows to seed from: a weighted draw, then ROUNDS draws of
    OVERSAMPLING * k rows by weight times squared distance to those drawn
    before.  A draw is a race without replacement: the rows with the least
    luck / weight.  Which rows win depends on their content
    alone, not on partitions, and each draw is one bounded top-k."""

    def draw(step: int, drawn: np.ndarray, n: int) -> np.ndarray:
        def run(batches):
            for b in batches:
                x, w = _matrix(b, dim)
                if len(drawn):
                    w = w * _nearest(x, drawn)[1]
                at = np.flatnonzero(w > 0)
                yield pa.RecordBatch.from_arrays(
                    [b.column("features").take(pa.array(at)), pa.array(_luck(x[at], seed, step) / w[at])], names=["features", "race"])

        won = rows.select("features", "weight").mapInArrow(run, "features array<double>, race double").orderBy("race", "features").limit(n)
        return np.array([r["features"] for r in won.collect()], float).reshape(-1, dim)

    drawn = draw(0, np.zeros((0, dim)), 1)
    for step in range(1, ROUNDS + 1):
        drawn = np.vstack((drawn, draw(step, drawn, OVERSAMPLING * k)))
    return drawn


def _sums(rows: DataFrame, dim: int, models: list[np.ndarray]) -> list[np.ndarray]:
    """Per model, the weight and the weighted sum of each centre's rows."""
    edges = np.cumsum([0] + [len(m) for m in models]).tolist()

    def run(batches):
        total = np.zeros((edges[-1], dim + 1))
        for b in batches:
            x, w = _matrix(b, dim)
            xw = np.hstack((w[:, None], x * w[:, None]))
            for centres, at in zip(models, edges):
                best = _nearest(x, centres)[0]
                for j in range(dim + 1):
                    total[at : at + len(centres), j] += np.bincount(best, xw[:, j], len(centres))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "s"])

    out = np.zeros(edges[-1] * (dim + 1))
    for cell, s in rows.select("features", "weight").mapInArrow(run, "cell int, s double").groupBy("cell").agg(F.sum("s")).collect():
        out[cell] = s
    out = out.reshape(-1, dim + 1)
    return [out[a:z] for a, z in zip(edges[:-1], edges[1:])]


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng) -> np.ndarray:
    """k of the weighted points, each drawn by weight times squared distance to those before."""
    chosen, far = [], np.ones(len(points))
    for _ in range(min(k, len(points))):
        p = weights * far
        if p.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=p / p.sum())))
        gap = np.square(points - points[chosen[-1]]).sum(1)
        far = gap if len(chosen) == 1 else np.minimum(far, gap)
    return points[chosen]


def kmeans_many(rows: DataFrame, dim: int, ks: Sequence[int], *, seed: int, max_iter: int = 20, tol: float = 1e-4) -> dict[int, np.ndarray]:
    """The centres of a KMeans model for each of ``ks``, fitted in lockstep.

    ``rows`` (features array<double> of length ``dim``, weight) should be stored: it is read once
    per iteration.  Seeds are drawn by :func:`candidates` and k-means++ over
    them.  A model is done when no centre moves by more than ``tol``; a centre
    without rows stays where it is.  A model has fewer than k centres where
    there are fewer different rows.  The driver holds the candidates
    (OVERSAMPLING * ROUNDS * max k) and the centres.
    """
    ks = [int(k) for k in ks]
    if not ks:
        return {}
    drawn = candidates(rows, dim, max(ks), seed)
    if not len(drawn):
        return {k: np.zeros((0, dim)) for k in ks}
    share = _sums(rows, dim, [drawn])[0][:, 0]
    centres = {k: _plus_plus(drawn, share, k, np.random.default_rng([seed, k])) for k in ks}
    open_ = list(ks)
    for _ in range(max_iter):
        if not open_:
            break
        for k, s in zip(list(open_), _sums(rows, dim, [centres[k] for k in open_])):
            had = s[:, 0] > 0
            new = centres[k].copy()
            new[had] = s[had, 1:] / s[had, :1]
            moved = np.sqrt(np.square(new - centres[k]).sum(1)).max()
            centres[k] = new
            if moved <= tol:
                open_.remove(k)
    return centres


def assigned_many(rows: DataFrame, dim: int, models: dict[int, np.ndarray]) -> DataFrame:
    """``k, cluster, features, weight``: every row with its cluster in every model."""

    def run(batches):
        for b in batches:
            x, _ = _matrix(b, dim)
            for k, centres in models.items():
                if len(centres) and len(x):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), k, np.int32)), pa.array(_nearest(x, centres)[0].astype(np.int32)), b.column("features"), b.column("weight")],
                        names=["k", "cluster", "features", "weight"])

    return rows.select("features", F.col("weight").cast("double").alias("weight")).mapInArrow(
        run, "k int, cluster int, features array<double>, weight double")
