"""Time-series analytics on PySpark: DataFrame operators, SQL front-end, sources, sinks and streaming."""
