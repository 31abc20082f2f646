"""Operators for training-data pipelines, apart from the rest of the library."""
