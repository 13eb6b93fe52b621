"""Sources and sinks: ingest protocols, files, result formats."""
