"""All queries: importing the modules registers them."""

from . import detect_queries, scalar_queries, source_queries, store_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
