"""All queries outside of the optional subpackage, with their SQL."""

from __future__ import annotations

from . import landscape, problems, spatial, weather

_PARTS = (problems, weather, spatial, landscape)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PARTS for k, s in p.SQL.items()}
