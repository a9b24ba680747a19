"""Operators on canonical frames and the general data-processing operators."""
