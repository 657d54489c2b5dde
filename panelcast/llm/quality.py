"""Document quality by attention-based multiple-instance learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import WordHasher, chunks, held_out, text_bytes

#: Bytes of a passage at most; lines end a passage too.
PASSAGE_BYTES = 512
HIDDEN, ATTENTION = 24, 16


def _byte_classes() -> np.ndarray:
    """Lower, upper, digit, space, line end, other control, each ASCII
    punctuation mark by itself, and bytes outside ASCII."""
    c = np.full(256, 5)
    c[97:123], c[65:91], c[48:58], c[[32, 9]], c[[10, 13]] = 0, 1, 2, 3, 4
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    c[marks] = 6 + np.arange(len(marks))
    c[128:] = 6 + len(marks)
    return c


CLASSES = _byte_classes()
N_CLASSES = int(CLASSES.max()) + 1
#: Coarse classes for what follows what: lower, upper, digit, blank, mark, other.
COARSE = np.select([CLASSES == 0, CLASSES == 1, CLASSES == 2, (CLASSES == 3) | (CLASSES == 4), (CLASSES >= 6) & (CLASSES < N_CLASSES - 1)], [0, 1, 2, 3, 4], 5)
FEATURES = N_CLASSES + 36 + 4


def passages(text: bytes) -> list[int]:
    """Start offsets of the passages of a text (at least one)."""
    out, at = [], 0
    for line in text.split(b"\n"):
        out.extend(range(at, at + max(len(line), 1), PASSAGE_BYTES))
        at += len(line) + 1
    return out


def encode(texts: list[bytes], hasher: WordHasher):
    """(features, counts): a row for each passage of the texts in turn, and the
    number of passages of each text.  Shares of byte classes and of class
    successions, share of words equal to the one before, mean word length,
    shortness and log length."""
    starts, counts, base = [], [], 0
    for t in texts:
        p = passages(t)
        starts.append(np.array(p) + base)
        counts.append(len(p))
        base += len(t) + 1
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, n = np.concatenate(starts), sum(counts)
    owner = np.zeros(len(joined), np.int64)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner)
    size = np.bincount(owner, minlength=n).astype(float)
    f = np.empty((n, FEATURES), np.float32)
    f[:, :N_CLASSES] = np.bincount(owner * N_CLASSES + CLASSES[joined], minlength=n * N_CLASSES).reshape(n, -1) / size[:, None]
    coarse = COARSE[joined]
    follow = coarse[:-1] * 6 + coarse[1:]
    f[:, N_CLASSES : N_CLASSES + 36] = np.bincount(owner[:-1] * 36 + follow, minlength=n * 36).reshape(n, -1) / size[:, None]
    h, doc, at, _, _ = hasher(texts)
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))) if len(h) else np.zeros(0, bool)
    f[:, -4] = np.bincount(owner[at[again]], minlength=n) / np.maximum(np.bincount(owner[at], minlength=n), 1)
    words = np.bincount(owner[:-1][(coarse[:-1] != 3) & (coarse[1:] == 3)], minlength=n)
    f[:, -3] = np.minimum(size / (words + 1), 40) / 10
    f[:, -2] = (size < 40)
    f[:, -1] = np.log1p(size) / 6
    return np.sqrt(np.abs(f)), np.array(counts)


def _init(rng) -> dict:
    def draw(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    return {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION),
            "a": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1)}


def forward(m: dict, x: np.ndarray, counts: np.ndarray) -> dict:
    """Gated attention: a_k ~ exp(a . (tanh(h V) * sigmoid(h U))), h = tanh(x W + b);
    the document is the a-weighted mean of its h."""
    h = np.tanh(x @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * g) @ m["a"]
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    doc = np.repeat(np.arange(len(counts)), counts)
    w = np.exp(e - np.maximum.reduceat(e, first)[doc])
    w /= np.add.reduceat(w, first)[doc]
    z = np.add.reduceat(w[:, None] * h, first, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -30, 30)))
    return {"h": h, "t": t, "g": g, "w": w, "z": z, "p": p, "doc": doc, "first": first}


def _gradients(m, x, counts, y):
    s = forward(m, x, counts)
    dl = (s["p"] - y) / len(y)
    dz = dl[:, None] * m["c"]
    dzk = dz[s["doc"]]
    dw = (s["h"] * dzk).sum(1)
    de = s["w"] * (dw - np.add.reduceat(s["w"] * dw, s["first"])[s["doc"]])
    dtg = de[:, None] * m["a"]
    dv, du = dtg * s["g"] * (1 - s["t"] ** 2), dtg * s["t"] * s["g"] * (1 - s["g"])
    dh = s["w"][:, None] * dzk + dv @ m["V"].T + du @ m["U"].T
    dpre = dh * (1 - s["h"] ** 2)
    return {"W": x.T @ dpre, "b": dpre.sum(0), "V": s["h"].T @ dv, "U": s["h"].T @ du,
            "a": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ dl, "d": dl.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, *, epochs: int = 25, batch: int = 64, rate: float = 0.01,
          decay: float = 1e-4, seed: int = 7) -> dict:
    """Adam on the log loss over bags of passages."""
    rng = np.random.default_rng(seed)
    m = _init(rng)
    m1, m2, step = {k: 0.0 for k in m}, {k: 0.0 for k in m}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = np.concatenate([bags[i] for i in rows])
            g = _gradients(m, x, np.array([len(bags[i]) for i in rows]), labels[rows])
            step += 1
            for k in m:
                d = g[k] + decay * m[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                m[k] = m[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return m


def training_ids(labels: DataFrame, label: str, folds: int, fold: int, limit: int) -> DataFrame:
    """(doc_id, y) of at most ``limit`` labelled rows outside the held-out
    fold, chosen by a hash of the doc_id.  A doc_id labelled twice counts
    with its larger label."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
            .where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id"), folds, fold))
            .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def training_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, y, text) for the ids that documents have, one row each: of the
    texts of a repeated doc_id the smallest, null before any other."""
    # At most as many ids of 16 bytes as the caller's limit: safe to broadcast.
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 5, fold: int = 0, max_docs: int = 3000,
        max_passages: int = 1000) -> dict:
    """A model from at most ``max_docs`` labelled documents, one text for each,
    and of a text at most ``max_passages`` passages, spread evenly over all of
    it (bound of what the driver gets: 320 bytes for a passage; some 10 MB for
    the test tables).  Scores see every passage."""
    ids = training_ids(labels, "quality", folds, fold, max_docs)

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            for y, t in zip(b.column("y").to_pylist(), text_bytes(b.column("text"))):
                x = encode([t], hasher)[0]
                if len(x) > max_passages:
                    x = x[np.arange(max_passages) * len(x) // max_passages]
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["y", "x"])

    chosen = training_texts(docs, ids).mapInArrow(run, "y int, x binary").collect()
    chosen.sort(key=lambda r: (r.y, bytes(r.x)))
    y = np.array([r.y for r in chosen], float)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    return train([np.frombuffer(r.x, np.float32).reshape(-1, FEATURES).astype(float) for r in chosen], y)


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    small = {k: v.astype(np.float32) for k, v in model.items()}
    hasher = WordHasher()
    out = [forward(small, *encode(texts[lo:hi], hasher))["p"] for lo, hi in chunks(texts)]
    return np.concatenate(out).astype(float) if out else np.zeros(0)


def scored(docs: DataFrame, model: dict, *, folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; the whole
    text counts, null as empty.  The score sees nothing but the text."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score_texts(model, text_bytes(b.column("text"))))], names=["doc_id", "score"])

    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return s.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(score_texts(model, text_bytes(b.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
