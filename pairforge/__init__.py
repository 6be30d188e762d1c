"""Typo-pair corpus preparation, scoring and run analytics on Spark DataFrames."""
