"""Every registered query and the SQL that must give the same rows."""

from __future__ import annotations

from shiftlens.plans import change_queries, evaluation_queries, lineage_queries, policy_queries, source_queries, stream_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

for _module in (change_queries, source_queries, lineage_queries, policy_queries, evaluation_queries, stream_queries):
    QUERIES.update(_module.registry.queries)
    ORACLE.update(_module.registry.oracle)
