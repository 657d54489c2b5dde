"""Sources and sinks: parquet tables, JDBC, result writing and reuse."""

from panelcast.sources.jdbc import jdbc_options, read_jdbc
from panelcast.sources.sinks import checkpoint_dir, materialize, write_result
from panelcast.sources.store import Results, bucket_count, read_bucketed, write_bridge, write_bucketed
from panelcast.sources.tables import TEST_TABLES, load_tables, table

__all__ = [
    "Results",
    "TEST_TABLES",
    "bucket_count",
    "checkpoint_dir",
    "jdbc_options",
    "load_tables",
    "materialize",
    "read_bucketed",
    "read_jdbc",
    "table",
    "write_bridge",
    "write_bucketed",
    "write_result",
]
