"""Expressions, delimiters and rounding."""
