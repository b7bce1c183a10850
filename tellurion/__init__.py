"""Telemetry analytics on Spark: metrics, logs and traces as lazy DataFrames."""
