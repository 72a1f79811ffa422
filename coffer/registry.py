"""Queries of the ledger operators over the given tables, and their SQL."""

from __future__ import annotations

from . import detection_oracle, detection_queries, engine_oracle, engine_queries, oracle, queries  # noqa: F401  (the queries register themselves)

QUERIES = queries.QUERIES
ORACLE_SQL: dict[str, str] = {**oracle.SQL, **detection_oracle.SQL, **engine_oracle.SQL}
