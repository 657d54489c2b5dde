"""Exact top-k search pruned by multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.llm.common import saved

#: Segments per vector at each resolution, coarse to fine.
LEVELS = (1, 4, 16)
#: Queries and candidates of a block.
QUERY_BLOCK, ROW_BLOCK = 1024, 8192


def quantized(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, rid, v): floor(scale * x) of every component as long.  Vectors
    that are null, empty or hold a null or non-finite component are left out.
    ``rid`` tells rows with the same vec_id apart."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
            .where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(F.size("embedding") > 0)
            .select("vec_id", x.alias("x")).where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
            .select("vec_id", F.monotonically_increasing_id().alias("rid"),
                    F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks of up to ``size`` vectors of one dimension."""

    def run(batches):
        held: dict[int, list] = {}

        def flush(dim, part):
            ids, rids, v = (np.concatenate(x) for x in zip(*part))
            for at in range(0, len(ids), size):
                cut = slice(at, at + size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), *(pa.array([x[cut].tobytes()], pa.binary()) for x in (ids, rids, v))],
                    names=["dim", "ids", "rids", "v"])

        for batch in batches:
            v = batch.column("v")
            offsets, flat = np.asarray(v.offsets), np.asarray(v.values)
            ids, rids = np.asarray(batch.column("vec_id")), np.asarray(batch.column("rid"))
            dims = np.diff(offsets)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                held.setdefault(dim, []).append((ids[at], rids[at], flat[offsets[at][:, None] + np.arange(dim)]))
                if sum(len(x[0]) for x in held[dim]) >= size:
                    yield from flush(dim, held.pop(dim))
        for dim, part in held.items():
            yield from flush(dim, part)

    return rows.mapInArrow(run, "dim int, ids binary, rids binary, v binary")


def segment_stats(v: np.ndarray, segments: int):
    """Means and deviations of each segment, both times sqrt(its length), so
    that a plain squared difference is a lower bound of the distance."""
    edges = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)
    width = np.diff(edges).astype(float)
    mean = np.add.reduceat(v, edges[:-1], axis=1) / width
    var = np.maximum(np.add.reduceat(v * v, edges[:-1], axis=1) / width - mean * mean, 0)
    return mean * np.sqrt(width), np.sqrt(var * width)


def block_top(q, q_id, q_rid, x, x_id, x_rid, k: int):
    """The k best rows of x for each row of q: (query row, x row, score).

    |q - x|^2 is at least the squared differences of segment means and
    deviations; so <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2 is at most a bound
    that tightens level by level.  Rows whose bound is below the k-th best
    exact score so far are pruned; survivors get their exact score."""
    exact = float if (np.abs(q).max(initial=0).astype(float) * np.abs(x).max(initial=0) * q.shape[1]) < 2**53 else np.int64
    qe, xe, qf, xf = q.astype(exact), x.astype(exact), q.astype(float), x.astype(float)
    q2, x2 = (qf * qf).sum(1), (xf * xf).sum(1)
    stats = [(segment_stats(qf, n), segment_stats(xf, n)) for n in LEVELS]
    seeds = min(len(x), max(4 * k, 64))
    best = [[] for _ in range(len(q))]
    first = (qe @ xe[:seeds].T).astype(np.int64)
    for i in range(len(q)):
        ok = np.flatnonzero(x_rid[:seeds] != q_rid[i])
        s = first[i, ok]
        floor = np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else None
        alive = np.arange(seeds, len(x))
        for (qm, qd), (xm, xd) in stats:
            if floor is None or not len(alive):
                break
            gap = ((xm[alive] - qm[i]) ** 2).sum(1) + ((xd[alive] - qd[i]) ** 2).sum(1)
            bound = (q2[i] + x2[alive] - gap) / 2
            # A little slack covers the rounding of the bounds.
            alive = alive[bound + 1e-9 * (q2[i] + x2[alive]) + 0.5 >= floor]
        alive = alive[x_rid[alive] != q_rid[i]]
        rows = np.concatenate((ok, alive))
        score = np.concatenate((s, (xe[alive] @ qe[i]).astype(np.int64)))
        top = np.lexsort((x_id[rows], -score))[:k]
        best[i] = (rows[top], score[top])
    return best


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible
    by ``every`` the ``k`` rows of highest integer inner product, ties to the
    smaller vec_id; all, if there are fewer.

    A query's own row is no candidate of it; another row with its vec_id is.
    Vectors of another length than the query's are no candidates.  Query
    blocks meet all blocks of rows, with results of k rows per query and
    block, merged by one window per query.
    """
    rows = saved(quantized(vectors, scale), "vectors")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = packed(asked.repartition(-(-asked.count() // QUERY_BLOCK) or 1), QUERY_BLOCK).select(
        "dim", F.col("ids").alias("q_ids"), F.col("rids").alias("q_rids"), F.col("v").alias("q"))
    blocks = saved(packed(rows, ROW_BLOCK), "blocks")
    # Every block of rows needs every query block: one copy of the queries for each group of row blocks.
    groups = max(1, min(blocks.count(), 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    blocks = blocks.withColumn("g", F.pmod(F.xxhash64("ids", "rids"), F.lit(groups)).cast("int"))
    queries = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, rids, q_ids, q_rids = (np.frombuffer(r[c], np.int64) for c in ("ids", "rids", "q_ids", "q_rids"))
                q, x = (np.frombuffer(r[c], np.int64).reshape(-1, r["dim"]) for c in ("q", "v"))
                best = block_top(q, q_ids, q_rids, x, ids, rids, k)
                n = [len(b[0]) for b in best]
                at = np.concatenate([b[0] for b in best])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(q_ids, n)), pa.array(np.repeat(q_rids, n)), pa.array(ids[at]),
                    pa.array(np.concatenate([b[1] for b in best]))], names=["query_id", "q_rid", "vec_id", "score"])

    near = blocks.join(queries, ["dim", "g"]).mapInArrow(run, "query_id long, q_rid long, vec_id long, score long")
    order = W.partitionBy("query_id", "q_rid").orderBy(F.desc("score"), "vec_id")
    return (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
