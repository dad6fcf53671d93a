"""A dynamic query language on Spark: expressions, filters and SQL compiled to DataFrames."""

from siftql.engine import Engine

__all__ = ["Engine"]
