"""Bibliographic analytics on Spark: queries, record linkage, ingestion and data cleaning."""

__version__ = "0.1.0"
