"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from corpaudit.plans import audit_queries, paper_queries, similarity_queries

_MODULES = [similarity_queries, paper_queries, audit_queries]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = similarity_queries.sim_phrase_pairs
