"""Group-indivisible splits that come as close as possible to their target sizes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.hashing import stable_fraction
from .names import own_prefix

#: Groups that a closest subset is chosen from on the driver, names and counts, at most.
MOST_GROUPS = 1_000_000
#: Different sums that are told apart; of larger targets sizes are counted in units.
MOST_SUMS = 1 << 24
#: Chosen groups that are broadcast; more are joined by a shuffle.
FEW_CHOSEN = 10_000


def _places(bits: int, width: int) -> np.ndarray:
    """The places of the ones of a long integer."""
    if bits.bit_count() < 16:
        out = []
        while bits:
            low = bits & -bits
            out.append(low.bit_length() - 1)
            bits ^= low
        return np.array(out, np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-width // 8), "little"), np.uint8), bitorder="little"))


def closest_subset(groups: list[tuple], target: int) -> set:
    """Groups whose sizes sum closest to ``target``; of ties the smaller sum, and the path found first.

    Sums found so far are the ones of one long integer, which a group shifts by
    its size; a sum remembers the group that found it.  Sums of twice the target
    and more are no closer than none and aren't followed.  Of targets over half
    of ``MOST_SUMS`` sizes are rounded to units, so the sum chosen is off by
    half a unit for each chosen group at most.
    """
    if target <= 0:
        return set()
    unit = -(-2 * target // MOST_SUMS)
    aim, width = round(target / unit), -(-2 * target // unit)
    sizes = [round(n / unit) for _, n in groups]
    reached, inside, found_by = 1, (1 << width) - 1, np.full(width, -1, np.int64)
    for i, n in enumerate(sizes):
        new = (reached << n) & inside & ~reached if n < width else 0
        if new:
            found_by[_places(new, width)] = i
            reached |= new
        if reached >> aim & 1:
            break  # nothing is closer, and its path was found first
    sums = _places(reached, width)
    at, out = int(min(sums, key=lambda t: (abs(t - aim), t))), set()
    while at:
        out.add(groups[found_by[at]][0])
        at -= sizes[found_by[at]]
    return out


def split_groups(df: DataFrame, group: str, seed: str, val: float = 0.10, test: float = 0.05) -> DataFrame:
    """``df`` with ``split``: train, val or test, whole groups at a time.

    Both targets are shares of all rows; test is chosen first.  Rows without a
    group are one group, the last in order; a column ``split`` is replaced.
    """
    if not (0 <= val < 1 and 0 <= test < 1 and val + test < 1):
        raise ValueError("shares must be in [0, 1) and leave something to train on")
    if group == "split":
        raise ValueError("the group can't be the column that is made")
    rows, p = df.drop("split"), own_prefix(df)
    counts = rows.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n")).withColumns({f"by_{x}": stable_fraction(F.col("group"), f"{seed}:{x}") for x in ("test", "val")})
    found = counts.limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups; assign them with stable_fraction")

    def ordered(part: str) -> list[tuple]:
        return [(r["group"], r["n"]) for r in sorted(found, key=lambda r: (r["group"] is None, r[f"by_{part}"] or 0.0, str(r["group"])))]

    total = sum(r["n"] for r in found)
    tests = closest_subset(ordered("test"), round(total * test))
    vals = closest_subset([x for x in ordered("val") if x[0] not in tests], round(total * val))
    chosen = [(g, "test") for g in tests] + [(g, "val") for g in vals]
    schema = StructType([StructField(p + "group", df.schema[group].dataType), StructField(p + "split", StringType())])
    named = df.sparkSession.createDataFrame(chosen, schema)
    named = F.broadcast(named) if len(chosen) <= FEW_CHOSEN else named
    joined = rows.join(named, F.col(group).eqNullSafe(F.col(p + "group")), "left")
    return joined.withColumn("split", F.coalesce(p + "split", F.lit("train"))).drop(p + "group", p + "split")


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(one, two, shared): keys found in both splits of each pair."""
    sides = df.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("found")).where(F.size("found") > 1)
    pairs = F.flatten(F.transform("found", lambda a, i: F.transform(F.slice("found", i + 2, F.size("found")), lambda b: F.struct(a.alias("one"), b.alias("two")))))
    return sides.select(F.inline(pairs)).groupBy("one", "two").agg(F.count("*").alias("shared"))
