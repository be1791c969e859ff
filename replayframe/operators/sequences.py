"""Ordered sequences: building, shifting, padding, streaks and rolling sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .names import own_prefix
from .ranges import range_sums


#: Items of one sequence.
MOST_ITEMS = 1_000_000


def build(df: DataFrame, key: str, order: list[str], items: Column) -> DataFrame:
    """(key, items, length): the items of each key in order, as one array.

    An array is a row, so this is for keys that are sequences of their own,
    such as hands; a key of more than ``MOST_ITEMS`` rows stops the job before
    its rows are gathered: they are counted as they lie, in the same shuffle.
    """
    p = own_prefix(df)
    ranked = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], items.alias("item"))
    counted = df.select(F.col(key).alias(key), ranked.alias(p + "row"), F.count("*").over(Window.partitionBy(key)).alias(p + "n"))
    few = F.when(F.col(p + "n") <= MOST_ITEMS, F.col(p + "row")).otherwise(F.raise_error(F.lit(f"a key has more than {MOST_ITEMS} rows; use windows or range sums")))
    listed = counted.groupBy(key).agg(F.sort_array(F.collect_list(few)).alias(p + "rows"))
    return listed.select(key, F.transform(p + "rows", lambda r: r["item"]).alias("items"), F.size(p + "rows").alias("length"))


def running_offset(df: DataFrame, partition: str, order: str | list[str], length: str, name: str = "offset") -> DataFrame:
    """Where each row's items would start if those of a partition stood end to end.

    A number is ordered by ranges of its values, so that a partition may go
    over many tasks; other orders keep a partition in one.
    """
    order = [order] if isinstance(order, str) else order
    if isinstance(df.schema[order[0]].dataType, NumericType):
        return range_sums(df, [partition], order, {name: F.col(length)})
    before = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(length).over(before), F.lit(0)))


def shift(tokens: Column, mask: Column) -> Column:
    """Inputs, targets and mask for predicting each next token."""
    n = F.size(tokens) - 1
    return F.struct(F.slice(tokens, 1, n).alias("inputs"), F.slice(tokens, 2, n).alias("targets"), F.slice(mask, 2, n).alias("mask"))


def pad(values: Column, width: Column, filler) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), (width - F.size(values)).cast("int")))


def streaks(df: DataFrame, partition: str, order: list[str], flag: str) -> DataFrame:
    """(partition, flag, longest): the longest run of equal flags."""
    one = F.row_number().over(Window.partitionBy(partition).orderBy(*order))
    two = F.row_number().over(Window.partitionBy(partition, flag).orderBy(*order))
    p = own_prefix(df)
    runs = df.withColumn(p + "island", one - two).groupBy(partition, flag, p + "island").agg(F.count("*").alias(p + "n"))
    return runs.groupBy(partition, flag).agg(F.max(p + "n").alias("longest"))


def rolling(df: DataFrame, partition: str, order: list[str], value: str, width: int, name: str = "rolled") -> DataFrame:
    """The sum over each full window of ``width`` rows; null before the first.

    A partition of fewer rows has one window, of all of them.
    """
    w = Window.partitionBy(partition).orderBy(*order)
    all_ = F.count("*").over(Window.partitionBy(partition))
    full = F.row_number().over(w) >= F.least(F.lit(width), all_)
    return df.withColumn(name, F.when(full, F.sum(value).over(w.rowsBetween(1 - width, 0))))


def prefix_all(df: DataFrame, partition: str, order: list[str], flag: str, name: str = "all_so_far") -> DataFrame:
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.min(F.col(flag).cast("int")).over(w) == 1)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    at = own_prefix(df) + "at"
    return df.withColumn(at, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(at) == 1).drop(at)


def spans(df: DataFrame, partition: str, order: list[str], marker: Column, name: str = "span") -> DataFrame:
    """Number the stretches that begin at each marker; 0 before the first."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(marker.cast("int")).over(w))


def shared_prefixes(df: DataFrame, key: str, items: str, lengths: tuple[int, ...]) -> DataFrame:
    """(key, k, n): for each of the ``lengths`` k that a sequence has, how many sequences begin with the same k items."""
    ks = F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.size(items))
    each = df.select(key, F.col(items).alias("__items"), F.explode(ks).alias("k"))
    # what is counted and joined is a hash with a check, not the items
    prefix = F.slice("__items", F.lit(1), F.col("k"))
    each = each.select(key, "k", F.xxhash64(prefix).alias("__a"), F.hash(prefix).alias("__b"))
    counts = each.groupBy("k", "__a", "__b").agg(F.count("*").alias("n"))
    return each.join(counts, ["k", "__a", "__b"]).select(key, "k", "n")


def exact_matches(candidates: DataFrame, stored: DataFrame, items: str) -> DataFrame:
    """``candidates`` with ``known``: whether ``stored`` has a sequence or text that is the same."""
    p = own_prefix(candidates)
    hashed, there = p + "hash", p + "there"
    key = lambda df: df.withColumns({hashed: F.xxhash64(items)})
    known = key(stored.select(items)).distinct().withColumn(there, F.lit(True))
    out = key(candidates).drop("known").join(known, [hashed, items], "left").withColumn("known", F.coalesce(there, F.lit(False)))
    return out.select(*[c for c in candidates.columns if c != "known"], "known")


def longest(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of a total order, without sorting the others."""
    return df.orderBy(*order).limit(k)


def first_and_last(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, first, last): the values of the first and the last row of each key."""
    at = F.struct(*order)
    return df.groupBy(key).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
