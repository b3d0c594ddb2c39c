"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; ``queries`` registers one query per operator.
"""
