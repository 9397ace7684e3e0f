"""Linked-read analytics on Spark: plain ``DataFrame -> DataFrame`` operators with their thresholds as parameters."""
