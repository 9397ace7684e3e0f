"""Operators for training data and sketches over very large sets and groups; nothing else in the library imports this."""
