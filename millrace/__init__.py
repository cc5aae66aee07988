"""Dataset jobs for Spark: range completeness, idempotent loads, keyed jobs, run history and lineage as DataFrames."""
