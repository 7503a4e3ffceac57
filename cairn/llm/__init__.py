"""Operators of training-data pipelines: ten numbered operators and their queries.

Nothing outside this subpackage imports it.
"""
