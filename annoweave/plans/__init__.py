"""The library's operators bound to the driver's tables, with the same results in SQL."""

from . import basics, files, transfers  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
