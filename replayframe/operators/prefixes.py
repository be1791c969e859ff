"""How many stored sequences begin as asked ones do, up to given lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import own_prefix
from .once import let
from .steps import materialize

#: Items that are hashed at once.
BLOCK = 64


def prefix_hashes(items: Column, ends: Column) -> Column:
    """(k, a, b) for each length of ``ends``: two hashes of the first k items.

    Blocks of items are hashed in a chain, all found in one pass; a length adds
    what is left after its last whole block.  Where other lengths lie has no
    bearing on a hash.
    """

    def hashed(before: Column, start: Column, count: Column) -> Column:
        def both(part: Column) -> Column:
            # hashes pass over nulls, so their places are hashed too
            nulls = F.when(F.exists(part, lambda x: x.isNull()), F.transform(part, lambda x: x.isNull()))
            return F.struct(F.xxhash64(before["a"], part, nulls).alias("a"), F.xxhash64(part, nulls, before["b"], F.lit("again")).alias("b"))

        return let(F.slice(items, start, count), both)

    first = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    whole = F.floor(F.size(items) / BLOCK).cast("int")
    blocks = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    chain = F.aggregate(blocks, first, lambda done, j: F.concat(done, F.array(hashed(F.element_at(done, -1), j * BLOCK + 1, F.lit(BLOCK)))))
    ks = F.transform(F.filter(F.array_distinct(ends), lambda k: (k >= 1) & (k <= F.size(items))), lambda k: k.cast("int"))

    def at(done: Column, k: Column) -> Column:
        j = F.floor(k / BLOCK).cast("int")
        return let(hashed(F.get(done, j), j * BLOCK + 1, k - j * BLOCK), lambda h: F.struct(k.alias("k"), h["a"].alias("a"), h["b"].alias("b")))

    return let(chain, lambda done: F.transform(ks, lambda k: at(done, k)))


def prefix_counts(asked: DataFrame, stored: DataFrame, key: list[str], items: str, ends: Column) -> DataFrame:
    """(key, k, n): for each sequence asked and each length in ``ends`` how many stored ones begin with the same k items.

    ``ends`` is an array of whole numbers made from the columns of either
    table; a stored sequence is looked up at its own ends.  Only hashes are
    shuffled, of stored sequences those that are asked for; a sequence that
    stands for all with its hashes is compared with the asked one itself.
    Lengths that a sequence doesn't have, and null sequences, have no row.
    Both tables are read twice, so what is costly should be written before; the
    counts are written here, so that few of them go to the stored sequences
    and not these to them.
    """
    p = own_prefix(asked, stored)
    at = [f"{p}{c}" for c in ("k", "a", "b")]
    own = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])

    def rows(df: DataFrame, *more: Column) -> DataFrame:
        each = df.select(*key, F.col(items).alias(p + "items"), F.explode(prefix_hashes(F.col(items), ends)).alias(p + "at"))
        return each.select(*key, *more, *[F.col(p + "at")[c[len(p) :]].alias(c) for c in at])

    prefix = F.slice(F.col(p + "items"), F.lit(1), F.col(p + "at")["k"])
    # counted before they meet what is asked, so that a prefix of many sequences isn't gathered in one task
    there = rows(stored).groupBy(*at).agg(F.count("*").alias(p + "n"), F.min(own).alias(p + "one"))
    counts = materialize(there.join(rows(asked).select(*at).distinct(), at), "prefix-counts")
    sample = rows(stored, own.alias(p + "one"), prefix.alias(p + "sample")).select(p + "one", p + "sample", *at)
    counts = counts.join(sample, [p + "one", *at]).dropDuplicates(at)
    met = rows(asked, prefix.alias(p + "prefix")).join(counts, at, "left")
    same = F.col(p + "prefix") == F.col(p + "sample")
    return met.select(*key, F.col(at[0]).alias("k"), F.when(same, F.col(p + "n")).otherwise(0).cast("long").alias("n"))
