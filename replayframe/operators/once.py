"""Columns that are worked out once for each row, however often later steps name them.

Catalyst puts the expression of a column in the place of its name wherever two
projections meet, and pushes filters below them, so a costly expression that is
named five times may be evaluated five times.  It moves neither through a
generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import own_prefix


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with these columns, each of them evaluated a single time; columns of the same names are replaced."""
    made = own_prefix(df) + "made"
    # an outer generator, as filters are inferred from the array of an inner one
    row = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(made)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select("*", row).select(*kept, *[F.col(made)[n].alias(n) for n in columns])


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; unlike a transform of one item this doesn't copy what comes out."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)
