"""All core queries and their SQL."""

from __future__ import annotations

from sievework.plans import index, ingest, problems, words

FLAGSHIP = "search_ranked"
MODULES = (problems, index, ingest, words)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
