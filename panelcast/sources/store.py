"""Bucketed tables and results found again.

``write_bucketed`` lays a table out by the hash of its key, so that counts by
the key and joins on it need no shuffle; ``write_bridge`` does so for a
multi-valued answer, whose equal rows become one with a count first;
``bucket_count`` says how many buckets tables of a size need.
``Results`` keeps results by operator, arguments and the versions of the input
files: the same call finds the stored copy, a changed input is computed anew.
All files lie in folders that the caller names on shared storage.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.missing import qcol
from panelcast.sources.sinks import write_result

#: Rows of a bucket: one task sorts, counts and joins a bucket's rows.
ROWS_PER_BUCKET = 1_000_000


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bucket_count(*tables: DataFrame, least: int = 1) -> int:
    """How many buckets the tables, which shall join, need: the largest has
    about ROWS_PER_BUCKET rows in each, so that a task's memory stays the same
    when the tables grow.  Rows of Parquet files are counted by their footers."""
    most = max(t.count() for t in tables)
    allowed = int(tables[0].sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(max(least, -(-most // ROWS_PER_BUCKET)), allowed)


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Store ``df`` at ``path`` as the table ``name``, bucketed and sorted by
    ``keys``, and return the table.

    Rows are shuffled by the keys once, so a bucket is one file.  Tables with
    the same number of buckets join on their keys, and group by them, without
    an exchange.  All rows of one key share a bucket: reduce keys that may hold
    a large share of all rows first (:func:`write_bridge`).
    """
    if buckets < 1 or not keys:
        raise ValueError("need keys and at least one bucket")
    return _stored(df.repartition(buckets, *[qcol(k) for k in keys]), name, path, keys, buckets)


def _stored(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The table of ``df``, whose partitions are the buckets."""
    (df.write.mode("overwrite").format("parquet")
     .bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(_sql_name(name)))
    return df.sparkSession.table(_sql_name(name))


def read_bucketed(spark: SparkSession, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The table that :func:`write_bucketed` left at ``path``, for a session
    whose catalog doesn't know it."""
    columns = ", ".join(f"{_sql_name(f.name)} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = ", ".join(_sql_name(k) for k in keys)
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_sql_name(name)} ({columns}) USING parquet "
              f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(_sql_name(name))


def write_bridge(bridge: DataFrame, key: str, items: Sequence[str], name: str, path: str, buckets: int,
                 mult: str = "mult") -> DataFrame:
    """``key, items, mult`` as a bucketed table: how often each entity names
    each combination of items, for ``Bridge(mult=...)`` and
    ``label_counts(mult=...)``.

    Rows are dealt over as many tasks as there are buckets and counted there, so
    no task counts a whole split of the input, most of whose rows differ.  Equal
    rows meet by the split that they come from, so a combination with a third of
    all rows is spread over tasks, and an entity adds at most a row per split and
    combination to its bucket, where these add up.
    """
    if buckets < 1:
        raise ValueError("need at least one bucket")
    by = [qcol(key), *[qcol(i) for i in items]]
    rows = bridge.select(*by, F.spark_partition_id().alias("_split"))
    counts = rows.repartition(buckets, *by, "_split").groupBy(*by, "_split").agg(F.count(F.lit(1)).alias(mult))
    whole = counts.repartition(buckets, qcol(key)).groupBy(*by).agg(F.sum(qcol(mult)).alias(mult))
    return _stored(whole, name, path, [key], buckets)


class Results:
    """Results stored under ``root``, found again by what they were made from.

    A result lies in ``root/operator/key/attempt``.  The key is a hash of the
    operator's name, its arguments and the version of every input file (path,
    length, time of change).  Only an attempt that was written to its end
    counts, so a lost driver or two writers at once do no harm.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, inputs: Sequence[str]) -> list:
        # Spark lists the files as rows; their contents are not read.
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(inputs))
                 .select(F.xxhash64("path", "modificationTime", "length").alias("h")))
        row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.bit_xor("h").alias("x")).first()
        return [row["n"], str(row["h"]), row["x"]]

    def _folder(self, operator: str, args: Mapping, inputs: Sequence[str]) -> str:
        if not operator or not operator.replace("_", "").isalnum():
            raise ValueError("operator names hold letters, digits and underscores")
        made_from = [operator, args, sorted(inputs), self._versions(inputs) if inputs else []]
        key = hashlib.sha256(json.dumps(made_from, sort_keys=True).encode()).hexdigest()[:32]
        return f"{self.root}/{operator}/{key}"

    def _stored(self, folder: str) -> str | None:
        fs, p = self._fs(folder + "/*/_SUCCESS")
        found = fs.globStatus(p) or []
        return min((f.getPath().getParent().toString() for f in found), default=None)

    def get(self, operator: str, args: Mapping, inputs: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
        """The stored result of ``build()``, which runs only if there is none
        for these arguments (anything JSON can hold) and these files."""
        folder = self._folder(operator, args, inputs)
        if self._stored(folder) is None:
            write_result(build(), f"{folder}/{uuid.uuid4().hex}", mode="errorifexists")
        return self.spark.read.parquet(self._stored(folder))

    def release(self, operator: str, args: Mapping | None = None, inputs: Sequence[str] = ()) -> bool:
        """Delete one result or, without ``args``, all of an operator, those of
        former input versions included.  False if there was none."""
        if not operator or not operator.replace("_", "").isalnum():
            raise ValueError("operator names hold letters, digits and underscores")
        fs, p = self._fs(f"{self.root}/{operator}" if args is None else self._folder(operator, args, inputs))
        return bool(fs.delete(p, True))
