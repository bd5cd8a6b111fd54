"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; it imports nothing from the rest of the library.
"""
