"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import analysis, basic, claims, scoring  # noqa: F401  all register their queries in basic

QUERIES = {**basic.QUERIES}
SQL = {**basic.SQL}
