"""Operators for large-scale text-corpus preparation.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
