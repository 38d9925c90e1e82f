"""Every query of the library by name, and the SQL that each is compared with."""

from __future__ import annotations

from sievework.plans import case_queries, contract_queries, evidence_queries, table_queries

QUERIES = {**table_queries.QUERIES, **case_queries.QUERIES, **evidence_queries.QUERIES, **contract_queries.QUERIES}
ORACLES = {**table_queries.ORACLES, **case_queries.ORACLES, **evidence_queries.ORACLES, **contract_queries.ORACLES}
