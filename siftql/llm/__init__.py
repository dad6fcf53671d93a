"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; the registry of its queries is
:mod:`siftql.llm.queries`.
"""
