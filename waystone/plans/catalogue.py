"""All registered queries."""

from . import (  # noqa: F401
    search_queries,
    source_queries,
    spatial_queries,
    stream_queries,
    text_queries,
    usage_queries,
)
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
