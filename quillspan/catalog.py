"""Every registered query and its SQL: name -> callable(spark, sf_dir), name -> DuckDB text."""

from __future__ import annotations

from .plans import content, documents, evaluation, protocol, retrieval, workspace  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
