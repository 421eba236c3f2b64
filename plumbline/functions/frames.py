"""Helpers on whole DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name, paired up so that the plan of many tables stays shallow."""
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return parts[0]
