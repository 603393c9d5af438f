"""All queries of the record operators, and the DuckDB SQL that states the same results."""

from __future__ import annotations

from leafmark.plans import exchange, images, lines, mrz, profiles, records, rows, scores, validate

_MODULES = (mrz, lines, rows, images, validate, profiles, records, scores, exchange)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
