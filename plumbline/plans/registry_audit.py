"""Registered queries: identifier audits of the derived query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import audit, onepass
from plumbline.operators.evaluate import execution_match
from plumbline.plans import derived, query_refs
from plumbline.plans.registry_eval import Query


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return query_refs.refs(spark, sf), query_refs.catalog(spark, sf)


def _verdicts(spark: SparkSession, sf: str, strict: bool = False) -> DataFrame:
    return onepass.verdicts(*_inputs(spark, sf), strict)


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    predictions = query_refs.predictions(spark, sf)
    matches = execution_match(predictions, derived.result_cells(spark, sf))
    return predictions, _verdicts(spark, sf), matches


def _catalog_index(spark: SparkSession, sf: str) -> DataFrame:
    """Each catalog column with the number of references to it, qualified or not."""
    refs, catalog = _inputs(spark, sf)
    used = refs.filter("kind = 'column'").groupBy(F.lower("name").alias("column")).agg(F.count("*").alias("n_refs"))
    return catalog.join(used, "column", "left").fillna(0, ["n_refs"])


def _closest(spark: SparkSession, sf: str) -> DataFrame:
    refs, catalog = _inputs(spark, sf)
    names = refs.filter("kind = 'table'").groupBy("name").agg(F.count("*").alias("n_refs"))
    return names.join(audit.closest_table(names, catalog), "name", "left")


def _owners(spark: SparkSession, sf: str) -> DataFrame:
    refs, catalog = _inputs(spark, sf)
    names = refs.filter("kind = 'column'").groupBy(F.lower("name").alias("column")).agg(F.count("*").alias("n_refs"))
    return names.join(audit.column_owners(catalog).select("column", "suggestion"), "column", "left")


def queries() -> dict[str, Query]:
    return {
        "catalog_index": _catalog_index,
        "unknown_tables": lambda s, d: audit.unknown_tables(*_inputs(s, d)),
        "closest_table": _closest,
        "column_owners": _owners,
        "alias_map": lambda s, d: audit.alias_map(query_refs.refs(s, d)),
        "unknown_qualified_columns": lambda s, d: audit.unknown_qualified_columns(*_inputs(s, d)),
        "out_of_scope_columns": lambda s, d: audit.out_of_scope_columns(*_inputs(s, d)),
        "policy_flags": lambda s, d: audit.policy_flags(query_refs.refs(s, d)),
        "audit_findings": lambda s, d: onepass.findings(*_inputs(s, d)),
        "audit_verdict": _verdicts,
        "audit_verdict_strict": lambda s, d: _verdicts(s, d, strict=True),
        "audit_confusion": lambda s, d: audit.audit_confusion(*_scored(s, d)),
        "audit_examples": lambda s, d: audit.audit_examples(*_scored(s, d)),
    }
