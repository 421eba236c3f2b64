"""Rounding that agrees with correctly rounded half-even on the binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int) -> Column:
    """Round a non-negative double by its exact binary value, half to even.

    `bround` rounds the printed decimal, so 1/160 = 0.00625 counts as a tie
    although the double lies slightly above it. Where the value prints as a
    tie, the sign of the exact distance decides. Splitting the value through a
    float keeps every product below 53 bits, so that distance is exact.
    """
    twice = 2.0 * 10**digits
    step = F.bround(value * twice, 0)
    on_tie = (step % 2 == 1) & (value == step / twice)
    high = value.cast("float").cast("double")
    distance = (step - high * twice) - (value - high) * twice
    scale = float(10**digits)
    return (
        F.when(on_tie & (distance > 0), (step - 1) / 2 / scale)
        .when(on_tie & (distance < 0), (step + 1) / 2 / scale)
        .otherwise(F.bround(value, digits))
    )


def decimal_text(value: Column, digits: int) -> Column:
    """A rounded double as plain decimal text: 0.4, 0.0, 1.0, 0.0004."""
    fixed = value.cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ".0")
