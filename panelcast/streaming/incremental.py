"""The counting operators over a streaming source.

The reference has no streams.  Its answer counts (A1) and histograms (A13)
are plain groupings, so the same operator code runs unchanged on a
streaming DataFrame: Structured Streaming keeps the running counts in its
state store and each trigger updates them.  ``write_snapshots`` publishes
the full current result after every micro-batch as a parquet table; its
checkpoint (offsets and state) lives in the shared ``spark.checkpoint.dir``
unless the caller names another shared location, so a restarted query
resumes where it stopped.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from panelcast.functions.missing import NULLS, Missing
from panelcast.operators.fanout import histogram
from panelcast.operators.share import distribution


def running_distribution(stream: DataFrame, col: str, missing: Missing = NULLS, where: Column | None = None,
                         count_col: str = "cnt") -> DataFrame:
    """Streaming A1: running count per answer (complete or update output mode)."""
    return distribution(stream, col, missing=missing, where=where, count_col=count_col)


def running_histogram(stream: DataFrame, col: str, lo: float, hi: float, bins: int,
                      weight: str | None = None) -> DataFrame:
    """Streaming A13: running bin counts; empty bins are not emitted."""
    return histogram(stream, col, lo, hi, bins, weight=weight, fill_empty=False)


def write_snapshots(agg: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                    processing_time: str | None = None) -> StreamingQuery:
    """Start the streaming aggregate; each micro-batch publishes the complete
    current result as its own folder ``path/version=N``, so readers of an
    earlier version see no half-written table.  ``checkpoint`` is the shared
    folder from which a restarted query goes on.

    ``available_now=True`` processes what the source holds and stops (batch
    style); otherwise the query runs with ``processing_time`` triggers.
    """
    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={epoch}")

    w = agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
