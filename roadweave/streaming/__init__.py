"""Incremental section status."""
