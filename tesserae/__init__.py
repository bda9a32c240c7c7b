"""Typed, linked object collections queried and changed through Spark DataFrames."""
