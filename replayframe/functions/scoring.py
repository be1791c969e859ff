"""Probabilities from arrays of logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, and not anew for each item of a lambda inside."""
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column) -> Column:
    powers = lambda z: _let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    shares = lambda ps: _let(F.aggregate(ps, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(ps, lambda p: p / total))
    return _let(logits, lambda z: _let(powers(z), shares))


def argmax(values: Column) -> Column:
    """The first place (from 0) of the greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(values: Column, k: int) -> Column:
    """The places (from 0) of the k greatest values; of equal ones the first."""
    ranked = F.array_sort(F.transform(values, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def group_sums(values: Column, groups: list[list[int]]) -> Column:
    """The sum of the values of each group of places."""
    return F.array(*[sum((values[i] for i in g), F.lit(0.0)) for g in groups])


def floored_loss(p: Column) -> Column:
    return -F.log(F.greatest(p, F.lit(1e-45)))


def sample(p: Column, uniform: Column) -> Column:
    """The place (from 0) that ``uniform``, from [0, 1), falls on among probabilities laid end to end."""
    so_far = F.aggregate(p, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)) + x)))
    return _let(so_far, lambda sums: _let(uniform * F.get(sums, F.size(sums) - 1), lambda at: F.least(F.size(F.filter(sums, lambda s: s <= at)), F.size(sums) - 1)))
