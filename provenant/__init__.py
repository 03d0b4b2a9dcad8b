"""Auditable communication records at scale, on Spark DataFrames."""
