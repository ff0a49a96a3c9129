"""Operators for preparing training data: search, mixing, joins, dedup, packing, output.

Nothing else in the library imports this subpackage. ``queries`` holds the registered ones.
"""
