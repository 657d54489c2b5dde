"""panelcast: panel and questionnaire analytics as Spark DataFrame operators.

Sub-packages
------------
functions  -- Column helpers: missing answers, ranges, ordinals, relabelling.
operators  -- shares, collapse, fan-out means and histograms, popularity vs
              demand, flows, associations, indicators and clustering.
sources    -- parquet tables, JDBC, result writing and lineage cuts.
plans      -- the operators on the test tables, their SQL oracle, and the
              named survey analyses.
streaming  -- the counting operators on streaming DataFrames.
"""

__version__ = "0.1.0"
