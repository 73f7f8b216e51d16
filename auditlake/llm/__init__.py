"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; removing the folder leaves the rest
of the library working.
"""
