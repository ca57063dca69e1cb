"""Queries by family; importing this package registers them all."""

from . import case_queries, extract_queries, keeping_queries, page_queries, policy_queries, source_queries, store_queries, text_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
