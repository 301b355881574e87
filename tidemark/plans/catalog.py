"""All queries of the engine by name, with the SQL that must give the same rows."""

from . import cases, records, relational, textual  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
