"""Toxicity: character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import held_out, text_bytes
from panelcast.llm.quality import training_ids, training_texts

#: Features: hashed character n-grams of these lengths, at a byte each.
GRAMS, BITS = (3, 4, 5), 18


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """The distinct feature numbers of a text.  ``seen`` is a work array of
    2**BITS ints that one task reuses."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    parts = []
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h = (h ^ b[j : j + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        parts.append(h >> np.uint32(32 - BITS))
    if not parts:
        return np.zeros(0, np.int64)
    h = np.concatenate(parts).astype(np.int64)
    at = np.arange(len(h), dtype=np.int32)
    seen[h] = at  # the last place of each feature stays
    return h[seen[h] == at]


def train(bags: list[np.ndarray], labels: np.ndarray, *, alpha: float = 1.0, epochs: int = 12, rate: float = 0.05,
          decay: float = 2e-4, least: int = 3, seed: int = 5) -> dict:
    """Logistic regression on presence features scaled by r, the log ratio of
    their smoothed shares in the two classes.  Adagrad, one text at a time."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    p, q = np.full(size, alpha), np.full(size, alpha)
    for x, y in zip(bags, labels):
        (p if y else q)[x] += 1
    r = np.log(p / (labels.sum() + 2 * alpha)) - np.log(q / ((1 - labels).sum() + 2 * alpha))
    r[p + q < least + 2 * alpha] = 0
    w, g2, bias, b2 = np.zeros(size), np.full(size, 1e-2), np.log(labels.mean() / (1 - labels.mean())), 1e-2
    bags = [x[r[x] != 0] for x in bags]
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            x = bags[i]
            rx = r[x]
            s = bias + rx @ w[x]
            d = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - labels[i]
            g = d * rx + decay * w[x]
            g2[x] += g * g
            w[x] -= rate * g / np.sqrt(g2[x])
            b2 += d * d
            bias -= rate * d / np.sqrt(b2)
    return {"v": (w * r).astype(np.float32), "bias": float(bias)}


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 4, fold: int = 2, max_docs: int = 4000,
        max_features: int = 1 << 14) -> dict:
    """A model from at most ``max_docs`` labelled documents, one text for each,
    and of a text at most ``max_features`` distinct features, those that come
    first when the numbers are mixed (bound of what the driver gets: four bytes
    a feature; some 50 MB for the test tables).  Scores see every feature."""
    ids = training_ids(labels, "toxic", folds, fold, max_docs)

    def run(batches):
        seen = np.zeros(1 << BITS, np.int32)
        for b in batches:
            for i, y, t in zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist(), text_bytes(b.column("text"))):
                x = features(t, seen)
                if len(x) > max_features:
                    x = x[np.argsort(x * 40503 % (1 << BITS))[:max_features]]  # an odd factor: no ties
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([x.astype(np.int32).tobytes()], pa.binary())], names=["doc_id", "y", "x"])

    chosen = training_texts(docs, ids).mapInArrow(run, "doc_id long, y int, x binary").collect()
    chosen.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    y = np.array([r.y for r in chosen], float)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    return train([np.frombuffer(r.x, np.int32) for r in chosen], y)


def scored(docs: DataFrame, model: dict, *, folds: int = 4, fold: int = 2, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; the whole
    text counts, null as empty.  The score sees nothing but the text."""

    def run(batches):
        seen = np.zeros(1 << BITS, np.int32)
        for b in batches:
            texts = text_bytes(b.column("text"))
            if "constant" in model:
                s = np.full(len(texts), model["constant"])
            else:
                s = np.array([model["bias"] + model["v"][features(t, seen)].sum(dtype=float) for t in texts])
                s = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return s.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"))
