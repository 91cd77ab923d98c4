"""Operators on DataFrames of zones, tiles, pixels and profiles."""
