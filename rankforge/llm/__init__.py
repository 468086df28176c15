"""Operators of a large training-data pipeline, one module per operator.

Nothing else in the library imports this subpackage; the entry module adds its
queries only if it can be imported.
"""
