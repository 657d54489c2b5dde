"""Results and reuse.

Operators return lazy DataFrames; nothing is brought to the driver here.
``write_result`` writes a result as parquet.  ``materialize`` cuts lineage
for a result that several actions reuse, either into a table the caller
names or through a reliable checkpoint in the cluster's shared
``spark.checkpoint.dir`` -- never on an executor's local disk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_result(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Applies it to the SparkContext if that has none yet.  Raises if the
    session names no folder: a machine-local default would not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Compute ``df`` once and return a DataFrame that reads the stored copy.

    With ``path`` the result is written there as parquet and read back;
    otherwise it is checkpointed (eagerly) into ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    if path is not None:
        write_result(df, path)
        return spark.read.parquet(path)
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)
