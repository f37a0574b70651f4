"""Sources and sinks: typed scans, CSV/parquet round trips, stored tables."""
