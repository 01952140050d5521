"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from . import recommend, tables  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = QUERIES["hyb9_batch_recommend"]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
