"""Counting operators on streaming DataFrames (see ``incremental``)."""

from panelcast.streaming.incremental import running_distribution, running_histogram, write_snapshots

__all__ = ["running_distribution", "running_histogram", "write_snapshots"]
