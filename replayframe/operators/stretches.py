"""Streaks, rolling sums and running conditions over one order of all rows, or of groups of any size.

The first column of the order is a number, and the whole order is total.  Rows
are dealt by ranges of that number; what a range passes on is a count, which
``range_sums`` adds up, or the last ``width - 1`` of its rows, the halo that the
next stretch needs.  So no task holds a group, and a group of 10^9 rows is as
good as one of ten.

Defined results: a null flag is a value of its own for streaks and false for
``prefix_all``; null values don't count in sums; columns of the user with the
names of steps come back, those named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .names import own_prefix
from .ranges import range_sums

#: Rows of a stretch that one task rolls over, at least; of wider windows a stretch is as long as the window.
STRETCH = 1 << 16


def ranked(df: DataFrame, by: list[str], order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the place of each row in its group, from 1."""
    return range_sums(df, by, order, {name: F.lit(1)}, ranges).withColumn(name, F.col(name) + 1)


def streaks(df: DataFrame, by: list[str], order: list[str], flag: str, ranges: int | None = None) -> DataFrame:
    """(by, flag, longest): the longest run of rows with equal flags.

    A row's place less its place among rows of its flag is the same all along
    a run, so runs are counted by an aggregation that begins where rows lie.
    """
    p = own_prefix(df)
    rows = df.select(*by, *[c for c in dict.fromkeys(order) if c not in by and c != flag], flag)
    placed = ranked(ranked(rows, by, order, p + "place", ranges), [*by, flag], order, p + "own", ranges)
    runs = placed.groupBy(*by, flag, (F.col(p + "place") - F.col(p + "own")).alias(p + "run")).agg(F.count("*").alias(p + "n"))
    return runs.groupBy(*by, flag).agg(F.max(p + "n").alias("longest"))


def rolling(df: DataFrame, by: list[str], order: list[str], value: str, width: int, name: str = "rolled", ranges: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """The sum over each full window of ``width`` rows; null before the first.  A group of fewer rows has one window, of all of them."""
    if width < 1:
        raise ValueError("a window has a row at least")
    p, length = own_prefix(df), max(stretch, width)
    place, cut, halo, all_ = (p + x for x in ("place", "cut", "halo", "all"))
    placed = ranked(df, by, order, place, ranges)
    at = F.floor((F.col(place) - 1) / length)
    # the last rows of a stretch also stand before the next one
    late = F.pmod(F.col(place) - 1, F.lit(length)) >= length - width + 1
    both = F.when(late, F.array(F.struct(at.alias("at"), F.lit(False).alias("lent")), F.struct((at + 1).alias("at"), F.lit(True).alias("lent"))))
    spread = placed.select("*", F.explode(F.coalesce(both, F.array(F.struct(at.alias("at"), F.lit(False).alias("lent"))))).alias(cut))
    spread = spread.withColumn(halo, F.col(cut)["lent"]).withColumn(cut, F.col(cut)["at"])
    window = Window.partitionBy(*by, cut).orderBy(place).rowsBetween(1 - width, 0)
    summed = spread.withColumn(p + "sum", F.sum(value).over(window)).where(~F.col(halo))
    counts = placed.groupBy(*[F.col(c).alias(f"{p}of_{c}") for c in by]).agg(F.count("*").alias(all_))
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"{p}of_{c}"))
    joined = summed.join(counts, match) if by else summed.join(F.broadcast(counts))
    full = F.col(place) >= F.least(F.lit(width), F.col(all_))
    rolled = F.when(full, F.col(p + "sum"))
    return joined.withColumn(name, rolled).drop(place, cut, halo, all_, p + "sum", *[f"{p}of_{c}" for c in by])


def prefix_all(df: DataFrame, by: list[str], order: list[str], flag: str, name: str = "all_so_far", ranges: int | None = None) -> DataFrame:
    """Whether the flag holds for a row and for all before it."""
    failed = (~F.coalesce(F.col(flag), F.lit(False))).cast("int")
    return range_sums(df, by, order, {name: failed}, ranges).withColumn(name, (F.col(name) == 0) & (failed == 0))
