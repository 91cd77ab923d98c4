"""Incremental processing of new tiles."""
