"""Batch curation and analytics of a transactions star schema on PySpark."""
