"""Leakage-safe, point-in-time relational and time-series operators on Spark DataFrames."""
