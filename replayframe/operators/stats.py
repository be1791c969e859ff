"""Exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .names import own_prefix
from .ranges import range_sums


def _counted(df: DataFrame, by: list[str], value: str, ranges: int | None) -> tuple[DataFrame, str]:
    """Distinct values of each group with the rows up to each and in all: what is ranked is a sum, not rows.

    Both are named under the prefix that comes with them.

    Values are ranked by ranges, so a group may go over many tasks.
    """
    p = own_prefix(df)
    n, upto = p + "n", p + "upto"
    each = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias(n))
    placed = range_sums(each, by, [value], {upto: F.col(n)}, ranges).withColumn(upto, F.col(upto) + F.col(n))
    whole = each.groupBy(*[F.col(c).alias(f"{p}of_{c}") for c in by]).agg(F.sum(n).alias(p + "all"))
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"{p}of_{c}"))
    return placed.join(whole, match).select(*by, value, F.col(upto).alias(f"{p}upto"), F.col(p + "all")), p


def _at(rank: Column, value: str, p: str) -> Column:
    """The value of a rank, counted from 1."""
    return F.min(F.when(F.col(p + "upto") >= rank, F.col(value)))


def nearest_rank(df: DataFrame, by: list[str], value: str, fractions: dict[str, float], ranges: int | None = None) -> DataFrame:
    """For each group the value at rank round-half-even((n - 1) f), by name."""
    ranked, p = _counted(df, by, value, ranges)
    at = {name: F.bround((F.col(p + "all") - 1) * F.lit(float(f))).cast("long") + 1 for name, f in fractions.items()}
    return ranked.groupBy(*by).agg(*[_at(k, value, p).alias(name) for name, k in at.items()])


def exact_median(df: DataFrame, by: list[str], value: str, name: str = "median", ranges: int | None = None) -> DataFrame:
    """The middle value, of an even number the mean of the middle two: exact for decimals, which get a place more."""
    kind = df.schema[value].dataType
    half = F.lit(2)
    if isinstance(kind, DecimalType):
        wide = f"decimal({min(38, kind.precision + 2)},{min(37, kind.scale + 1)})"
        df = df.withColumn(value, F.col(value).cast(wide))
    ranked, p = _counted(df, by, value, ranges)
    low, high = _at(F.floor((F.col(p + "all") + 1) / 2), value, p), _at(F.floor(F.col(p + "all") / 2) + 1, value, p)
    middle = (low + high) / half
    if isinstance(kind, DecimalType):
        middle = middle.cast(wide)
    return ranked.groupBy(*by).agg(middle.alias(name), F.first(p + "all").alias("n"))
