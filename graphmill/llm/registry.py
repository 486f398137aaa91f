"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import descriptions, encoding, packing, personal, provenance, secrets, splitting, validity

_PARTS = (splitting, validity, descriptions, secrets, provenance, encoding, packing, personal)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
