"""Running sums and ranks of groups that need not fit a task, by ranges of a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import own_prefix

#: Ranges that rows are dealt by: about so many rows each, and at most so many.
RANGE_ROWS, MOST_RANGES = 1_000_000, 16_384


def bounds(df: DataFrame, number: str, ranges: int | None = None) -> list:
    """Where ranges of about equal row counts end, at most ``MOST_RANGES`` numbers."""
    if ranges is None:
        n = df.agg(F.count("*")).first()[0]
        ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    if ranges < 2:
        return []
    shares = [k / ranges for k in range(1, ranges)]
    return sorted(set(df.agg(F.percentile_approx(number, shares, max(10_000, 4 * ranges))).first()[0] or []))


def bucket(number: Column, ends: list) -> Column:
    """How many ends lie below a number, by a binary search; nulls come first."""
    if not ends:
        return F.lit(0)
    values = F.array(*map(F.lit, ends))

    def further(low: Column, step: Column) -> Column:
        at = low + step
        return F.when((at <= len(ends)) & (F.get(values, at - 1) < number), at).otherwise(low)

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(ends).bit_length()))])
    return F.when(number.isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), further))


def range_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``df`` with the sums over the rows of the same ``by`` that come before in ``order``.

    The first column of ``order`` is a number: rows are dealt by group and
    range of it, each range is summed up by itself, and only a row per group
    and range is added up in order.  Which range a row is in follows from its
    value alone, so a task that runs again gives the same.  A column named as
    a sum is replaced.
    """
    ends, p = bounds(df.where(F.col(order[0]).isNotNull()), order[0], ranges), own_prefix(df)
    place, add, all_, before = (p + x for x in ("range", "add_", "all_", "before_"))
    placed = df.withColumns({place: bucket(F.col(order[0]), ends), **{add + n: c for n, c in sums.items()}})
    inside = Window.partitionBy(*by, place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = {n: F.coalesce(F.sum(add + n).over(inside), F.lit(0)) for n in sums}
    if not ends:
        return placed.withColumns(own).drop(place, *[add + n for n in sums])
    totals = placed.groupBy(*by, place).agg(*[F.sum(add + n).alias(all_ + n) for n in sums])
    earlier = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    keys = {f"{p}key_{k}": F.col(k) for k in (*by, place)}
    starts = totals.select(*[c.alias(k) for k, c in keys.items()], *[F.coalesce(F.sum(all_ + n).over(earlier), F.lit(0)).alias(before + n) for n in sums])
    match = F.lit(True)
    for k, c in keys.items():
        match = match & c.eqNullSafe(F.col(k))
    out = placed.withColumns(own).join(starts, match).withColumns({n: F.col(n) + F.col(before + n) for n in sums})
    return out.drop(place, *keys, *[add + n for n in sums], *[before + n for n in sums])
