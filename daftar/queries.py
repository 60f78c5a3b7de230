"""Registered queries of the engine's own operators, with the DuckDB SQL each is checked against."""

from __future__ import annotations

from daftar.plans import activity, catalog, stores, texts, vectors

FLAGSHIP = "users_over_time"
_PLANS = (activity.R, catalog.R, texts.R, vectors.R, stores.R)
QUERIES = {name: f for r in _PLANS for name, f in r.queries.items()}
ORACLE_SQL = {name: sql for r in _PLANS for name, sql in r.sql.items()}
