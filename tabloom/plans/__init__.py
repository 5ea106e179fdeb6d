"""Generators of control rows."""
