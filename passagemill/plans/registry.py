"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from . import answers, business, changes, evaluation, ingest, norms, phrases, relational, retrieval, rules, text, times, upkeep  # noqa: F401  they register themselves
from .base import ORACLE_SQL, QUERIES  # noqa: F401
