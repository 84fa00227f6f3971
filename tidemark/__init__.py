"""Leakage-aware analytics for tables and sensor time series, written as Spark jobs."""
