"""Shared helpers: tables, scratch storage, vectorised hashing of words."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_U64 = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text that a task works on at a time (a longer text is worked on alone).
CHUNK_BYTES = 1 << 21
#: Keys of 8 or 16 bytes that are broadcast at most (some ten MB).
BROADCAST_KEYS = 1 << 18
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    A local folder of its own is made only in local mode with that setting
    unset (tests); elsewhere a missing setting is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="panelcast-scratch-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared scratch folder and read again:
    computed once, lineage cut, readable after the loss of any executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Shuffle files of a finished job go when the driver collects its garbage;
    # asked for here, disks hold one step's files rather than all steps'.
    gc.collect()
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def matching(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in the one-column table ``ids``
    (stored: it is counted here).  Up to BROADCAST_KEYS keys go to every
    executor; more meet the rows in a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, key, "left_semi")


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`saved` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id, folds: int, fold: int):
    """True for rows whose crc32(doc_id as text) mod ``folds`` is ``fold``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def text_bytes(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES):
    """Row ranges (start, stop) of about ``limit`` bytes of text each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of many texts at once.

    A word is a run of bytes other than space and 0x09-0x0D.  Its hash is a
    polynomial over its bytes, taken from prefix sums, then finalised.
    """

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.power, self.inverse = base, np.ones(0, np.uint64), np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            def powers(b):
                p = np.full(n, b & (2**64 - 1), np.uint64)
                p[0] = 1
                return np.cumprod(p, dtype=np.uint64)
            self.power, self.inverse = powers(self.base), powers(pow(self.base, -1, 2**64))

    def __call__(self, texts: list[bytes]):
        """(hashes, doc, start, end, buffer): for each word its hash, the index
        of its text and its byte range in the joined buffer."""
        joined = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        word = ~_SEPARATOR[buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        self._grow(len(buf))
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.power[: len(buf)], out=sums[1:])
        h = mixed((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        doc = np.searchsorted(offsets, start, side="right") - 1
        return h, doc, start, end, joined


def gram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of every ``n`` consecutive entries (length len(h) - n + 1)."""
    n, m = int(n), len(h) - int(n) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(m, (seed * 0x2545F4914F6CDD1D + n) & (2**64 - 1), np.uint64)
    for j in range(n):
        acc = (acc ^ h[j : j + m]) * np.uint64(0xD6E8FEB86659FD93)
        acc ^= acc >> np.uint64(32)
    return mixed(acc)


def list_array(values: np.ndarray, counts, kind) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def longs(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
