"""Compressed-vector analytics, expressed as Spark DataFrame transformations."""
