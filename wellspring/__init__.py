"""Windowed event queries that carry their lineage, on PySpark."""
