"""Relational sources over JDBC.

The reference pulls each query result through one JDBC connection (the
``query`` option cannot be combined with a partition column).  Here a query
is wrapped as a derived table, so a partition column splits the read into
``num_partitions`` parallel range queries.  Connection options come from the
caller; nothing is read from the environment.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    *,
    table: str | None = None,
    query: str | None = None,
    options: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    lower_bound=None,
    upper_bound=None,
    num_partitions: int | None = None,
    fetchsize: int = 1000,
) -> dict[str, str]:
    """The option map for ``spark.read.format("jdbc")``."""
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table= or query=")
    opts = {"url": url, "fetchsize": str(fetchsize)}
    opts.update({k: str(v) for k, v in (options or {}).items()})
    if partition_column is not None:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("a partition column needs lower_bound, upper_bound and num_partitions")
        src = table if table is not None else f"({query.strip().rstrip(';')}) q"
        opts.update(
            dbtable=src,
            partitionColumn=partition_column,
            lowerBound=str(lower_bound),
            upperBound=str(upper_bound),
            numPartitions=str(int(num_partitions)),
        )
    elif table is not None:
        opts["dbtable"] = table
    else:
        opts["query"] = query
    return opts


def read_jdbc(spark: SparkSession, url: str, **kwargs) -> DataFrame:
    """Lazy DataFrame over a JDBC table or query; see :func:`jdbc_options`.

    Filters and column choices on the result are pushed into the remote
    query by Spark's JDBC source.  Errors propagate to the caller.
    """
    return spark.read.format("jdbc").options(**jdbc_options(url, **kwargs)).load()
