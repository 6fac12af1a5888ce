"""Operators of the vector-item store."""
