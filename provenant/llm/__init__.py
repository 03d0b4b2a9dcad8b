"""Operators of large-scale training-data preparation.

Nothing outside this package imports it; `registry` lists its queries.
"""
