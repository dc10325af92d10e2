"""Sources and sinks: explicit-schema scans, the submission sink, and the
relations the pipelines read (derived from the parquet test tables)."""
