"""Parquet tables as DataFrames (the main source)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``<root>/<name>.parquet`` (a file or a directory of parts), lazily.

    Scans are columnar: Catalyst prunes columns and pushes filters into the
    parquet reader, so callers select and filter freely afterwards.
    """
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, root: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Dict of lazily read tables.  ``names`` defaults to every ``*.parquet``
    entry under ``root``, listed through Hadoop's file systems."""
    if names is None:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        found = [e.getPath().getName() for e in entries]
        names = sorted(n[: -len(".parquet")] for n in found if n.endswith(".parquet"))
    return {n: table(spark, root, n) for n in names}
