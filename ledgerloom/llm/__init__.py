"""Operators of a training-data pipeline, each a Spark job with its own general interface.

Nothing outside this package imports it. ``queries`` registers one query per operator.
"""
