"""Asset-graph analytics on Spark DataFrames: ingest, traversal, audit, drift, correlation, reports."""
