"""All registered queries."""

from __future__ import annotations

from plumbline.plans import registry_audit, registry_catalog, registry_eval, registry_logs, registry_retrieval
from plumbline.plans.registry_eval import Query


def queries() -> dict[str, Query]:
    parts = (registry_eval, registry_catalog, registry_retrieval, registry_audit, registry_logs)
    return {name: query for part in parts for name, query in part.queries().items()}
