"""Replication-integrity and transfer-telemetry analytics on Spark DataFrames."""
