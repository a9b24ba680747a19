"""Operators for training-data pipelines that are more than plain data processing. Nothing outside this folder imports it."""
