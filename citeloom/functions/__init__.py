"""Expressions and statistics used by the operators."""
