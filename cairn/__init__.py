"""Cairn: analytics over content-addressed, deduplicated block stores, as Spark DataFrames."""
