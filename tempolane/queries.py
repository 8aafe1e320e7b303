"""All registered queries over the star-schema tables."""

from __future__ import annotations

from tempolane.catalog import features, tables  # noqa: F401, I001  (registers; audits use the SQL of these)
from tempolane.catalog import audits, backtest, documents  # noqa: F401
from tempolane.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
