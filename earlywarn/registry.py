"""Registered queries of the early-warning operators and their DuckDB SQL."""

from __future__ import annotations

from earlywarn.plans import clinical_queries, fhir_queries, message_queries, model_queries, stream_queries, ward_queries

_MODULES = (message_queries, fhir_queries, ward_queries, clinical_queries, stream_queries, model_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
