"""Ridgeline: zonal terrain analytics on Spark DataFrames."""
