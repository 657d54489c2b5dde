"""Query plans: the operators placed on the test tables (``testbed``), their
DuckDB oracle (``oracle``) and the reference's named analyses over
survey-shaped tables (``survey``)."""
