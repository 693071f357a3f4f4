"""Similarity joins on PySpark."""

from nearpair.api import similarity_join

__all__ = ["similarity_join"]
