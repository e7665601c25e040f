"""Lineage-recorder analytics on Spark DataFrames."""
