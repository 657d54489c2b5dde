"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import WordHasher, chunks, gram_hashes, longs, matching, mixed, saved, text_bytes
from panelcast.llm.graph import bucket_components, one_by_one

#: Hashes compared at a time by the verification.
BATCH = 24


def shingle_sets(texts: list[bytes], size: int, hasher: WordHasher):
    """For each text the sorted distinct 64-bit fingerprints of its word
    shingles.  A text of fewer words has its whole sequence as its only
    shingle, a text without words the empty set."""
    h, doc, _, _, _ = hasher([t.lower() for t in texts])
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    grams = gram_hashes(h, size)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        else:
            yield gram_hashes(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def prune_below(hashes: int, threshold: float, miss: float) -> list[int]:
    """Fewest agreeing hashes after each batch for which the posterior chance
    of similarity >= threshold is at least ``miss`` (uniform prior; compared
    bytes also agree by chance, 1 time in 256)."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, hashes + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        like = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(like - like.max(axis=1, keepdims=True))
        out.append(int(np.argmax(like[:, s >= threshold].sum(axis=1) / like.sum(axis=1) >= miss)))
    return out


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, keys, sig) per row of docs: two hashes of
    the whole set, the band keys and one byte of each MinHash."""
    n_hash = bands * rows
    rng = np.random.default_rng(seed)
    mul = (rng.integers(0, 2**32, n_hash, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    add = rng.integers(0, 2**32, n_hash, dtype=np.uint64).astype(np.uint32)

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            texts, ids = text_bytes(batch.column("text")), batch.column("doc_id")
            for lo, hi in chunks(texts):
                sizes, h1, h2, keys, sigs = [], [], [], [], []
                for s in shingle_sets(texts[lo:hi], shingle, hasher):
                    sizes.append(len(s))
                    h1.append(mixed(s).sum(dtype=np.uint64))
                    h2.append(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    if not len(s):
                        keys.append(None)
                        sigs.append(None)
                        continue
                    x = (s >> np.uint64(32)).astype(np.uint32)
                    low = np.full(n_hash, 0xFFFFFFFF, np.uint32)
                    for at in range(0, len(x), 1024):
                        part = x[None, at : at + 1024] ^ add[:, None]
                        part *= mul[:, None]
                        np.minimum(low, part.min(axis=1), out=low)
                    wide = mixed(low.astype(np.uint64)).reshape(bands, rows)
                    key = np.zeros(bands, np.uint64)
                    for r in range(rows):
                        key = mixed(key * np.uint64(31) + wide[:, r])
                    keys.append(longs(key).tolist())
                    sigs.append((wide & np.uint64(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([
                    ids[lo:hi].cast(pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary()),
                ], names=["doc_id", "n_shingles", "h1", "h2", "keys", "sig"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, sig binary")


def plausible(threshold: float, miss: float, hashes: int):
    """Whether signatures survive the sequential comparison: a mask over pairs
    of rows, each dropped at the first batch that makes it implausible."""
    least = prune_below(hashes, threshold, miss)

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        agree, alive = np.zeros(len(x), np.int64), np.arange(len(x))
        for k, need in enumerate(least):
            cut = slice(k * BATCH, (k + 1) * BATCH)
            agree[alive] += (x[alive, cut] == y[alive, cut]).sum(axis=1)
            alive = alive[agree[alive] >= need]
        mask = np.zeros(len(x), bool)
        mask[alive] = True
        return mask

    return alike


def near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: int = 80, bands: int = 40, rows: int = 6,
                    miss: float = 1e-5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id, kept.

    Two documents are linked when 100 * |A & B| >= similarity * |A | B| for
    their sets of distinct word shingles (A-Z lower-cased, words are runs
    other than space and 0x09-0x0D); component_id is the smallest doc_id
    reachable.  Equal sets are one class.  Class representatives that share a
    band of their MinHash are candidates; ``bucket_components`` keeps them in
    proportion to the classes.  A candidate's signature is read batch by
    batch and dropped once the posterior chance of enough similarity falls
    under ``miss``; survivors are compared on their full sets.  With the
    default bands a pair at similarity 0.8 fails to be a candidate 5 times in
    a million.

    Null, empty and word-less texts have the empty set and are linked with
    nothing.  Rows that repeat a doc_id count as one document.  A null doc_id
    has a null component and is kept.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    s = saved(sketches(docs, shingle, bands, rows), "sketches")
    full = s.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # One row per class: its smallest doc_id with that row's sketch.
    reps = saved(full.groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("doc_id", "keys", "sig")).alias("r"))
                 .select("h1", "h2", "n_shingles", "r.*").withColumnRenamed("doc_id", "id"), "classes")
    members = reps.select("id", F.posexplode("keys").alias("band", "key")).distinct()

    comps = bucket_components(
        members, ["band", "key"], reps.select("id", "sig"), plausible(similarity / 100, miss, bands * rows),
        lambda ids: set_bodies(docs, ids, shingle), one_by_one(sets_similar(similarity)))
    named = (reps.select("h1", "h2", "n_shingles", "id").join(comps, "id", "left")
             .select("h1", "h2", "n_shingles", F.coalesce("comp", "id").alias("component_id")))
    return (s.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def set_bodies(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, body): the whole shingle set of the documents with these ids."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            texts, own = text_bytes(batch.column("text")), batch.column("doc_id")
            for lo, hi in chunks(texts):
                yield pa.RecordBatch.from_arrays([own[lo:hi], pa.array(
                    [x.tobytes() for x in shingle_sets(texts[lo:hi], shingle, hasher)], pa.binary())], names=["id", "body"])

    return matching(docs, ids.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "text").mapInArrow(run, "id long, body binary")


def sets_similar(similarity: int):
    def holds(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if similarity * max(len(x), len(y)) > 100 * min(len(x), len(y)):
            return False
        both = np.concatenate((x, y))
        both.sort(kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        return 100 * shared >= similarity * (len(x) + len(y) - shared)

    return holds
