"""Canonical encoding of result cells.

Every cell becomes a non-null tagged string, so that equality of encoded cells
is equality of the values: nulls equal nulls, 1 equals 1.0 equals true, and a
decimal or a date only equals its own text.

    N          null
    D:<n>      number or boolean
    S:<text>   anything else, as text
    U:<json>   a nested value read from JSON (never equal as a row)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Doubles of this size and more are whole and don't fit a bigint; from the second bound on not a decimal either.
_BEYOND_BIGINT = float(2**63)
_BEYOND_DECIMAL = 9e36


def _number_text(value: Column) -> Column:
    """A double's exact text if it is whole, so that it equals the whole number of that value; else its shortest one."""
    size = F.abs(value)
    small = F.when(size < F.lit(_BEYOND_BIGINT), value).cast("bigint")
    # Two parts without a rounding: both are whole multiples of the value's last bit.
    large = F.when((size >= F.lit(_BEYOND_BIGINT)) & (size < F.lit(_BEYOND_DECIMAL)), value)
    high = F.floor(large / F.lit(_BEYOND_BIGINT))
    low = (large - high.cast("double") * F.lit(_BEYOND_BIGINT)).cast("bigint").cast("decimal(19,0)")
    exact = high.cast("decimal(18,0)") * F.lit(str(2**63)).cast("decimal(19,0)") + low
    return F.coalesce(
        F.when(small.cast("double") == value, small.cast("string")), exact.cast("string"), value.cast("string")
    )


def encode_cell(value: Column, dtype: T.DataType) -> Column:
    """Encode one column of a known Spark type."""
    if isinstance(dtype, T.BooleanType):
        body = F.concat(F.lit("D:"), value.cast("int").cast("string"))
    elif isinstance(dtype, T.IntegralType):
        body = F.concat(F.lit("D:"), value.cast("string"))
    elif isinstance(dtype, T.FloatType):
        # Through text, so that the real 0.1 is the number 0.1.
        body = F.concat(F.lit("D:"), _number_text(value.cast("string").cast("double")))
    elif isinstance(dtype, T.DoubleType):
        body = F.concat(F.lit("D:"), _number_text(value))
    else:
        body = F.concat(F.lit("S:"), value.cast("string"))
    return F.coalesce(body, F.lit("N"))


def encode_variant(value: Column) -> Column:
    """Encode one cell read from JSON as a variant."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    text = F.try_variant_get(value, "$", "string")
    # Usual kinds first: the kind is found out anew for every question asked about it.
    return (
        F.when(kind == "BIGINT", F.concat(F.lit("D:"), text))
        .when(kind == "STRING", F.concat(F.lit("S:"), text))
        .when(kind == "VOID", F.lit("N"))
        .when(
            kind == "BOOLEAN",
            F.concat(F.lit("D:"), F.try_variant_get(value, "$", "boolean").cast("int").cast("string")),
        )
        # A whole number beyond bigint.
        .when(kind.rlike("^DECIMAL[(][0-9]+,0[)]$"), F.concat(F.lit("D:"), F.try_variant_get(value, "$", "decimal(38,0)").cast("string")))
        .when(
            kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"),
            F.concat(F.lit("D:"), _number_text(F.try_variant_get(value, "$", "double"))),
        )
        .otherwise(F.concat(F.lit("U:"), F.to_json(value)))
    )


def cells_of(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The encoded cells of a row of `df`, in column order."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.array(*[encode_cell(F.col(f"`{c}`"), types[c]) for c in (columns or df.columns)])


def cell_json(cell: Column) -> Column:
    """An encoded cell as the JSON value it stands for."""
    body = F.substring(cell, 3, 2**31 - 1)
    # Quotation marks enclose the text, so only the brackets of the array are trimmed.
    quoted = F.btrim(F.to_json(F.array(body)), F.lit("[]"))
    return (
        F.when(cell == "N", F.lit("null"))
        .when(cell.startswith("S:"), quoted)
        .otherwise(body)
    )


def row_json(cells: Column) -> Column:
    """A row of encoded cells as a JSON array."""
    return F.concat(F.lit("["), F.array_join(F.transform(cells, cell_json), ","), F.lit("]"))
