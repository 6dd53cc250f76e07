"""Every query of the contract operators by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import codec_queries, lint_queries, manifest_queries, registered_queries, registry_queries, validation_queries

_MODULES = (validation_queries, registry_queries, registered_queries, codec_queries, lint_queries, manifest_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = "minimum_slice"
