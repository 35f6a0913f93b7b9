"""All queries of the engine and their SQL."""

from __future__ import annotations

from egresslake.plans import aggregate_queries, document_queries, evidence_queries, fit_queries, guidance_queries, movement_queries, report_queries, route_queries, step_queries, structure_queries, summary_queries, trajectory_queries

MODULES = (trajectory_queries, aggregate_queries, structure_queries, step_queries, summary_queries, movement_queries, evidence_queries, route_queries, guidance_queries, fit_queries, document_queries, report_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
