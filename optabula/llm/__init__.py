"""Operators for training-data pipelines: one module each, built on DataFrames and SQL functions."""
