"""The registered queries of the library's own operators: QUERIES and ORACLE_SQL by name."""

from __future__ import annotations

from itemloom.plans import admissions, archives, bank, checks, drafts, geometry, guidance, integrity, layouts, lifecycle, ordering, papers, search, stores, streams, workflow

_MODULES = (search, ordering, workflow, checks, layouts, lifecycle, bank, admissions, papers, stores, geometry, guidance, integrity, streams, archives, drafts)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
