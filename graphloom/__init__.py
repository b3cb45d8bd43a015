"""Source-graph and migration-state analytics on Spark DataFrames."""
