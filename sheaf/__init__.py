"""Catalog analytics on Spark: acquired pages and inventory files in, DataFrames out."""

__version__ = "0.1.0"
