"""Tabular machine-learning data engine written against the public PySpark API."""
