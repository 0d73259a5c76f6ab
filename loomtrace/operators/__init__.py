"""Operators of the query language as DataFrame transformations."""
