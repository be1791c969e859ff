"""Range buckets: half-open intervals (lower, upper] over a ratio that is never divided."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The upper bounds of the buckets, and their names.
THRESHOLDS = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 20.0, 50.0, 75.0, 100.0, 150.0)
#: Buckets that a decision can name; the larger ones only describe context.
OUTPUTS = 10


def _text(x: float) -> str:
    return f"{x:g}"


def labels() -> list[str]:
    """Every bucket in order: nothing, the intervals, and all above."""
    edges = ("0", *map(_text, THRESHOLDS))
    return ["ZERO", *[f"{a}_TO_{b}" for a, b in zip(edges, edges[1:])], f"GT_{edges[-1]}"]


def range_bucket(value: Column, base: Column, exact: bool = False) -> Column:
    """The bucket of ``value / base`` for a positive base, by comparing products; ``exact`` for decimal columns."""
    names = labels()

    def among(low: int, high: int) -> Column:
        """The bucket, if it is one of these; halving takes four comparisons where a search in order takes up to fourteen."""
        if low == high:
            return F.lit(names[low])
        half = (low + high) // 2
        bound = THRESHOLDS[half - 1]
        return F.when(value <= F.lit(Decimal(_text(bound)) if exact else bound) * base, among(low, half)).otherwise(among(half + 1, high))

    return F.when(value <= 0, names[0]).otherwise(among(1, len(names) - 1))


def intervals() -> list[tuple[str, float, float | None, float | None]]:
    """(bucket, lower, upper, midpoint) of the intervals; the last is open above."""
    edges = (0.0, *THRESHOLDS)
    return [*[(n, a, b, (a + b) / 2) for n, a, b in zip(labels()[1:], edges, edges[1:])], (labels()[-1], edges[-1], None, None)]


def interval_distance(lower: Column, upper: Column, truth: Column) -> Column:
    """How far ``truth`` lies outside an interval; at its lower bound the distance is 0."""
    return F.when(truth <= lower, lower - truth).when(upper.isNotNull() & (truth > upper), truth - upper).otherwise(F.lit(0.0))


def chip_bounds(bucket: Column, base: Column) -> Column:
    """(lower, upper, lower_included, upper_included): a bucket's interval times its base; null for ZERO, and no upper bound for the last."""
    out = F.lit(None).cast("struct<lower:double,upper:double,lower_included:boolean,upper_included:boolean>")
    for name, lower, upper, _ in intervals():
        top = base * F.lit(upper) if upper is not None else F.lit(None).cast("double")
        bounds = F.struct((base * F.lit(lower)).alias("lower"), top.alias("upper"), F.lit(False).alias("lower_included"), F.lit(upper is not None).alias("upper_included"))
        out = F.when(bucket == name, bounds).otherwise(out)
    return out


def contains(bounds: Column, value: Column) -> Column:
    """Whether a value lies in an interval, whose ends count if they are included."""
    low = F.when(bounds["lower_included"], value >= bounds["lower"]).otherwise(value > bounds["lower"])
    high = F.when(bounds["upper"].isNull(), True).when(bounds["upper_included"], value <= bounds["upper"]).otherwise(value < bounds["upper"])
    return low & high
