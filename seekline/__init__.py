"""Seekline: search and retrieval analytics as composable PySpark DataFrames."""

__version__ = "0.1.0"
