"""Substring de-duplication: seeds on winnowed anchors, extended both ways."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import WordHasher, chunks, dropped, gram_hashes, longs, mixed, saved, text_bytes

#: Words of an anchor.
ANCHOR_WORDS = 5
#: Passes that the stored windows are compared in, each those of one remainder
#: of the hash: disks hold the shuffles of one pass at a time.
PASSES = 3


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    out = x[: len(x) - n + 1].copy()
    for j in range(1, n):
        op(out, x[j : j + len(out)], out=out)
    return out


def _windows(h: np.ndarray, doc: np.ndarray, min_words: int):
    """For every start of ``min_words`` words the smallest anchor hash inside
    that window; the second array is False where the window leaves its text.

    Equal windows have equal smallest anchors, so every repeat of at least
    ``min_words`` words shares at least one."""
    if len(h) < min_words:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    k = min(ANCHOR_WORDS, min_words)
    inside = doc[min_words - 1 :] == doc[: len(doc) - min_words + 1]
    return _slide(gram_hashes(h, k), min_words - k + 1, np.minimum), inside


def anchors(docs: DataFrame, min_words: int) -> DataFrame:
    """(anchor, doc_id): the distinct winnowed anchors of every row."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            texts, ids = text_bytes(batch.column("text")), np.asarray(batch.column("doc_id"))
            for lo, hi in chunks(texts):
                h, doc, _, _, _ = hasher(texts[lo:hi])
                low, inside = _windows(h, doc, min_words)
                low, at = low[inside], doc[: len(low)][inside]
                if not len(low):
                    continue
                new = np.concatenate(([True], (low[1:] != low[:-1]) | (at[1:] != at[:-1])))
                low, at = low[new], at[new]
                order = np.lexsort((low, at))
                low, at = low[order], at[order]
                new = np.concatenate(([True], (low[1:] != low[:-1]) | (at[1:] != at[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(longs(low[new])), pa.array(ids[at[new] + lo])], names=["anchor", "doc_id"])

    return docs.mapInArrow(run, "anchor long, doc_id long")


def _window_hashes(texts: list[bytes], one: WordHasher, two: WordHasher, min_words: int):
    """(smallest anchor, window hash, text number, inside its text) of every
    window.  The hash mixes two independent hashes of the word sequence."""
    h, doc, _, _, _ = one(texts)
    low, inside = _windows(h, doc, min_words)
    both = gram_hashes(h, min_words, 1)
    both = mixed(both + np.uint64(3) * gram_hashes(two(texts)[0], min_words, 2))
    return longs(low), longs(both), doc[: len(low)], inside


def seeded_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(w, doc_id) for the windows of ``docs`` (with a column ``seeds``) whose
    smallest anchor is one of the row's seeds: each seed extended both ways
    to every window of ``min_words`` words that it stands for.  w is a 64-bit
    hash of the window's word sequence."""

    def run(batches):
        one, two = WordHasher(), WordHasher(0xC2B2AE3D27D4EB4F)
        for batch in batches:
            texts, seeds = text_bytes(batch.column("text")), batch.column("seeds")
            ids, ends, flat = np.asarray(batch.column("doc_id")), np.asarray(seeds.offsets), np.asarray(seeds.values)
            for lo, hi in chunks(texts):
                low, w, doc, inside = _window_hashes(texts[lo:hi], one, two, min_words)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    cut = slice(first[i], first[i + 1])
                    hit = inside[cut] & np.isin(low[cut], flat[ends[lo + i] : ends[lo + i + 1]])
                    if hit.any():
                        own = np.unique(w[cut][hit])
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), ids[lo + i]))], names=["w", "doc_id"])

    return docs.select("doc_id", "text", "seeds").mapInArrow(run, "w long, doc_id long")


def without_repeats(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """``docs`` rows as (doc_id, n_words, n_removed, kept_text, repeats).

    Words are runs of bytes other than space and 0x09-0x0D, unchanged.  A
    window is ``min_words`` consecutive words of one document.  A word goes
    when a window that covers it also starts in a document with a smaller
    doc_id, judged on the input.  ``kept_text`` holds the other words joined
    by one space; ``repeats`` the maximal runs of removed words as
    (first, last).

    Winnowing keeps the smallest five-word anchor of every window.  Anchors
    that occur in two documents are the seeds; each is extended both ways to
    all windows it stands for, equal windows meet by their 64-bit hashes with
    their smallest doc_id, and overlapping matches merge into maximal
    repeats.  A passage shared by many documents costs rows per occurrence,
    never per pair of documents.

    Null text has no words.  Rows with a null doc_id neither lose words nor
    count as a source; rows that repeat a doc_id don't reduce each other.
    Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = anchors(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), min_words)
    repeated = (found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                .where("lo < hi").select("anchor"))
    seeds = saved(found.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("seeds")), "seeds")
    windows = saved(seeded_windows(docs.join(seeds, "doc_id"), min_words), "windows")
    dropped(seeds)
    found = []
    for part in range(PASSES):
        own = windows.where(F.pmod("w", F.lit(PASSES)) == part)
        firsts = (own.groupBy("w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                  .where("lo < hi").select("w", "lo"))
        found.append(saved(own.join(firsts, "w").where("doc_id > lo").groupBy("doc_id").agg(F.collect_set("w").alias("found")), "covered"))
    dropped(windows)
    covered = reduce(DataFrame.unionAll, found).groupBy("doc_id").agg(F.flatten(F.collect_list("found")).alias("found"))

    def cut(batches):
        one, two = WordHasher(), WordHasher(0xC2B2AE3D27D4EB4F)
        for batch in batches:
            texts, found = text_bytes(batch.column("text")), batch.column("found")
            ids = batch.column("doc_id")
            for lo, hi in chunks(texts):
                _, doc, a, b, joined = one(texts[lo:hi])
                _, w, _, inside = _window_hashes(texts[lo:hi], one, two, min_words)
                word0 = np.searchsorted(doc, np.arange(hi - lo + 1))
                n_words, n_gone, kept, runs, n_runs = [], [], [], [], []
                for i in range(hi - lo):
                    n = word0[i + 1] - word0[i]
                    gone = np.zeros(n + 1, np.int32)
                    if found[lo + i].is_valid:
                        part = slice(word0[i], min(word0[i + 1], len(w)))
                        s = np.flatnonzero(inside[part] & np.isin(w[part], np.asarray(found[lo + i].values)))
                        gone[s] += 1
                        gone[s + min_words] -= 1
                    gone = np.cumsum(gone)[:n] > 0
                    stay = np.flatnonzero(~gone) + word0[i]
                    kept.append(b" ".join([joined[x:y] for x, y in zip(a[stay].tolist(), b[stay].tolist())]))
                    step = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                    run = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1], axis=1)
                    runs.append(run)
                    n_runs.append(len(run))
                    n_words.append(n)
                    n_gone.append(int(gone.sum()))
                flat = np.concatenate(runs).astype(np.int64)
                pair = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["first", "last"])
                offsets = pa.array(np.concatenate(([0], np.cumsum(n_runs))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    ids[lo:hi], pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(offsets, pair),
                ], names=["doc_id", "n_words", "n_removed", "kept_text", "repeats"])

    return docs.join(covered, "doc_id", "left").select("doc_id", "text", "found").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_text string, repeats array<struct<first: long, last: long>>")
