"""All SQL equivalents."""

from __future__ import annotations

from plumbline.plans import oracle_audit, oracle_catalog, oracle_eval, oracle_logs, oracle_retrieval


def sql() -> dict[str, str]:
    parts = (oracle_eval, oracle_catalog, oracle_retrieval, oracle_audit, oracle_logs)
    return {name: text for part in parts for name, text in part.sql().items()}
