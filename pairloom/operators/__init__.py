"""Joins, set operations, top-k and the other relational operators."""
