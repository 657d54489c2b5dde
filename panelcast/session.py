"""Session settings for running the operators locally (tests, bench).

The library never creates or stops a session itself; callers own it.  These
settings are the ones the operators are designed around: adaptive execution
(partition coalescing, skew-join splitting, runtime broadcast from measured
sizes) on, the Spark UI off.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Delete checkpoint files once the checkpointed data is unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def runtime_filter_conf(entities: int, min_scan: str = "10GB") -> dict[str, str]:
    """Settings under which joins of a filtered entity table with a bridge
    first send a Bloom filter of the entities' keys to the bridge scan, so that
    rows of other entities are dropped before they are counted or shuffled.

    ``entities`` is how many the filter is expected to keep.  The Bloom filter
    takes 8 bits for each, at most 64 MB; with more keys than fit it lets more
    rows through, and results stay the same.  Spark adds it only where the
    bridge scan has at least ``min_scan`` bytes.
    """
    bits = min(8 * max(entities, 1), 1 << 29)
    return {
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": str(bits // 8),
        "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": str(bits // 8),
        "spark.sql.optimizer.runtime.bloomFilter.numBits": str(bits),
        "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(bits),
        # Spark's estimate of the filtered side, from its files; the filter itself is bounded above.
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": min_scan,
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "panelcast",
                  driver_memory: str = "8g", checkpoint_dir: str | None = None) -> SparkSession:
    """A local session; ``checkpoint_dir`` names the folder for stored steps."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
    )
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir is not None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir)
    return spark
