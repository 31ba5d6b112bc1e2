"""Event-log analytics on Spark: logs of traces and events as DataFrames."""
