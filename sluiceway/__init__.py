"""Ingest event streams into partitioned tables with Spark DataFrames and Structured Streaming."""

__version__ = "0.1.0"
