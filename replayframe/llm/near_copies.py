"""Near copies by the Jaccard similarity of word shingles, found by SimHash and BK-trees.

A link joins two texts whose sets of five-word shingles have a similarity of at
least ``SIMILARITY``.  At first the SimHash fingerprints of the sets go through
the BK-trees of ``simhash.links``; what these link within two bits is checked by
the exact sets.  At 0.8, though, fingerprints of 128 bits differ in about 20 bits
(and up to some 40), too many for bands of bits to be equal.  The shards that
can hold the other partners are therefore named by bands of ``BAND`` min-hashes;
of so many bands two sets at the least similarity have none in common once in
``1 / LOST`` pairs, and more alike ones far less often.  A text has as many
shards as bands, however long it is.

A few rounds link each member of a shard to the one before it in an order.  In
shards of few members the others are then compared by size and fingerprint, and
what is near is checked by the exact sets.  Larger shards are cut into parts of
bounded size, and two parts meet in a unit that has the exact sets of both and
passes on only links that join components, so no row stands for a pair that is
not linked.  A part has one component where that is large, and parts of one
component don't meet; sets without a partner by size and fingerprint stay away.

Defined results: texts without words are copies of each other; texts of fewer
words than a shingle have one, all their words; white space and ASCII case don't
count; a null doc_id comes after all others; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, discard, materialize, released
from .components import connected_components
from .simhash import _LOWER, links, one_row_each

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of 128 that fingerprints of linked texts may differ in: five standard deviations over the mean at 0.8.  Those of
#: unlike texts differ in 64 bits and hardly ever in so few.
RADIUS = 40
#: Sets of fewer shingles are compared without fingerprints, whose bits vary too much then.
SHORT = 64
#: Members of a shard that a join compares, at most; shingles of a part of a larger one, and those that a member counts for at least.
FEW, PART, LEAST = 8, 1 << 19, 1 << 8
#: Members of a part that are multiplied at once, and shingles; shingles of fewer of them are counted pair by pair.
ROWS, COLUMNS, COMMON = 512, 4096, 16
#: Pairs of rows that are counted at once.
PAIRS = 1 << 20
#: Orders of a shard in which each member is compared with the one before it.
ORDERS = (("n", "fp", "set"), ("fp2", "n", "set"))
#: One in so many shards takes part in the rounds of neighbours, which only spare comparisons.
CHAINED = 4
#: Min-hashes of a band, and pairs at the least similarity that share no band, at most; shingles that are hashed at once.
BAND, LOST, HASHED = 3, 1e-10, 4096


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted longs."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(_LOWER).split()
    parts = zip(*(words[k:] for k in range(shingle))) if len(words) > shingle else [words] if words else []
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(x), 42) for x in parts), np.uint64).view(np.int64))


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """The SimHash of a set of shingles, 128 bits as two signed longs; the second half is of hashes made from the first's."""
    if not len(found):
        return 0, 0
    x = found.view(np.uint64)
    y = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    y = (y ^ (y >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    out = []
    for hashes in (x, y ^ (y >> np.uint64(32))):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(found), bitorder="little").view("<i8")[0]))
    return out[0], out[1]


@cache
def _factors(bands: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 64, bands * BAND + BAND, np.uint64) | np.uint64(1)


def band_count(similarity: float) -> int:
    """So many bands that sets of this similarity or more have one in common, but for one in ``1 / LOST`` pairs."""
    return math.ceil(math.log(LOST) / math.log1p(-(similarity**BAND))) if similarity < 1 else 1


def band_keys(found: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band of min-hashes of a set of shingles; none for an empty set."""
    if not len(found):
        return found
    factors = _factors(bands)
    by, last = factors[: bands * BAND], factors[bands * BAND :]
    x = found.view(np.uint64)
    least = reduce(np.minimum, [(x[a : a + HASHED, None] * by).min(0) for a in range(0, len(x), HASHED)]).reshape(bands, BAND)
    y = ((least ^ (least >> np.uint64(29))) * last).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * last[0]
    return ((y ^ (y >> np.uint64(31))) * last[-1]).view(np.int64)


def _sets(plain: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(__id, __same, set, fp, fp2, n, keys): ``set`` names the shingles of the text."""
    bands = band_count(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                found = [shingle_set(t, shingle) for t in batch["__text"].cast(pa.binary()).to_pylist()]
                columns = [
                    batch["__id"],
                    batch["__same"],
                    pa.array(np.array([xxh64_intdigest(x.tobytes(), 42) for x in found], np.uint64).view(np.int64)),
                    *[pa.array(half, pa.int64()) for half in zip(*map(fingerprint, found), strict=True)],
                    pa.array([len(x) for x in found], pa.int32()),
                    pa.array([band_keys(x, bands) for x in found], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["__id", "__same", "set", "fp", "fp2", "n", "keys"])

    return plain.mapInArrow(released(run), "__id long, __same long, set long, fp long, fp2 long, n int, keys array<long>")


def _by_fingerprint(each: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints BK-trees link, or that have the same one: they join all such sets."""
    heads = materialize(each.groupBy("fp").agg(F.min("set").alias("head")), "heads")
    found = links(heads.select("fp"))
    one, two = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")) for c in "ab")
    between = found.join(one, "a").join(two, "b").select(F.least("a_head", "b_head").alias("a"), F.greatest("a_head", "b_head").alias("b"))
    same = each.join(heads, "fp").where("set <> head").select(F.col("head").alias("a"), F.col("set").alias("b"))
    out = materialize(between.union(same), "fingerprint_pairs")
    discard(heads, found)
    return out


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of sets that have the similarity; ``texts`` has (set, __text)."""
    pairs = materialize(pairs, "pairs")
    asked = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()

    found = materialize(_shingles(texts, asked, shingle), "shingles")
    left, right = (found.select(F.col("set").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    out = materialize(pairs.join(left, "a").join(right, "b").where(both / (F.size("of_a") + F.size("of_b") - both) >= similarity).select("a", "b"), "verified")
    discard(pairs, found)
    return out


def _alike(other: str, radius: int, similarity: float) -> Column:
    """Whether sizes and fingerprints (n, fp, fp2, and those with the prefix ``other``) let two sets have the similarity."""
    bits = [F.bit_count(F.col(c).bitwiseXOR(F.col(other + c))) for c in ("fp", "fp2")]
    n, m = F.col("n"), F.col(f"{other}n")
    return ((bits[0] + bits[1] <= radius) | (F.least(n, m) < SHORT)) & (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9)


def _shingles(texts: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """(set, shingles) of the sets ``asked`` for; ``texts`` has a text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle) for t in batch["__text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["set"], pa.array(found, pa.list_(pa.int64()))], ["set", "shingles"])

    return texts.join(asked, "set", "left_semi").mapInArrow(released(run), "set long, shingles array<long>")


MEMBER = ("set", "fp", "fp2", "n", "label")


def _small(some: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of shards of at most ``FEW`` members, by a join: a member meets no more than ``FEW`` others."""
    small = some.where(F.col("all") <= FEW).drop("all")
    other = small.select("key", *[F.col(c).alias(f"other_{c}") for c in MEMBER])
    met = small.join(other, "key").where((F.col("set") < F.col("other_set")) & (F.col("label") != F.col("other_label")) & _alike("other_", radius, similarity))
    return met.select(F.col("set").alias("a"), F.col("other_set").alias("b"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``; sets hold no value twice."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    both = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    if not len(both):
        return out
    at = []
    for values, rows in sides:  # (column, row) of what is on both sides, by column
        place = np.minimum(np.searchsorted(both, values), len(both) - 1)
        known = both[place] == values
        order = np.argsort(place[known], kind="stable")
        at.append((place[known][order], rows[known][order]))
    starts = [np.searchsorted(columns, np.arange(len(both) + 1)) for columns, _ in at]
    counts = [np.diff(s) for s in starts]
    rare = counts[0] * counts[1] <= COMMON * COMMON
    # each pair of rows of a rare column
    here = np.flatnonzero(rare)
    ends = np.cumsum((counts[0] * counts[1])[here])
    flat = out.reshape(-1)
    for some in np.split(here, np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS))) if len(here) else ():
        column = np.repeat(some, (counts[0] * counts[1])[some])
        nth = np.arange(len(column)) - np.searchsorted(column, column)
        i, j = nth // counts[1][column], nth % counts[1][column]
        cells, times = np.unique(at[0][1][starts[0][column] + i] * len(right) + at[1][1][starts[1][column] + j], return_counts=True)
        flat[cells] += times
    common = np.flatnonzero(~rare)
    for some in np.array_split(common, 1 + len(common) // COLUMNS) if len(common) else ():
        tables = []
        for (columns, rows), size in zip(at, out.shape, strict=True):
            table = np.zeros((size, len(some)), np.float32)
            place = np.minimum(np.searchsorted(some, columns), len(some) - 1)
            known = some[place] == columns
            table[rows[known], place[known]] = 1
            tables.append(table)
        for a in range(0, len(left), ROWS):
            out[a : a + ROWS] += tables[0][a : a + ROWS] @ tables[1].T
    return out


def unit_links(left: list[np.ndarray], right: list[np.ndarray] | None, labels: tuple[np.ndarray, np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between the sets of two parts (or within one, if ``right`` is None) that join all components that any link joins.

    Places in ``left``, then in ``right``.  Sets with the same label are joined already.
    """
    own = right is None
    right = left if own else right
    sizes = [np.array([len(x) for x in sets], np.float32) for sets in (left, right)]
    shared = overlaps(left, right)
    # the same division as in ``verified``, on whole numbers
    near = labels[0][:, None] != labels[1][None, :]
    for a in range(0, len(left), ROWS):
        some = shared[a : a + ROWS].astype(np.float64)
        near[a : a + ROWS] &= some / (sizes[0][a : a + ROWS, None].astype(np.float64) + sizes[1][None, :] - some) >= similarity
    out: list[tuple[int, int]] = []
    if own:
        new = np.ones(len(left), bool)
        for first in np.flatnonzero(near.any(1)):
            todo = [first] if new[first] else []
            new[first] = False
            while todo:
                here = todo.pop()
                found = np.flatnonzero(near[here] & new)
                new[found] = False
                out += [(here, x) for x in found]
                todo += found.tolist()
        return out
    new = [np.ones(len(left), bool), np.ones(len(right), bool)]
    for first in np.flatnonzero(near.any(1)):
        todo = [(0, first)] if new[0][first] else []
        new[0][first] = False
        while todo:
            side, here = todo.pop()
            found = np.flatnonzero((near[here] if side == 0 else near[:, here]) & new[1 - side])
            new[1 - side][found] = False
            out += [(here, x) if side == 0 else (x, here) for x in found]
            todo += [(1 - side, x) for x in found.tolist()]
    return out


def _parts(some: DataFrame) -> DataFrame:
    """The members of the larger shards with the part of each: a component of its own, where it is large, or some small ones."""
    large = some.where(F.col("all") > FEW).drop("all")
    held = large.groupBy("key", "label").agg(F.sum(F.greatest("n", F.lit(LEAST))).alias("held"))
    rest = held.where(F.col("held") < PART // 2).groupBy("key").agg(F.sum("held").alias("rest"))
    sized = held.join(rest, "key", "left")
    own = F.col("held") >= PART // 2
    count = lambda c: F.ceil(F.col(c) / PART).cast("int")
    sized = sized.select("key", "label", own.alias("own"), F.when(own, count("held")).otherwise(count("rest")).alias("parts"))
    named = F.when(F.col("own"), F.xxhash64("label", F.pmod(F.xxhash64("set"), "parts"))).otherwise(F.pmod(F.xxhash64("label"), "parts"))
    return large.join(sized, ["key", "label"]).select("key", *MEMBER, named.alias("part"))


UNIT = ("key", "low", "high")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each unit, of batches sorted by unit."""
    unit, rows = None, []
    for batch in batches:
        columns = [batch[c].to_numpy() for c in UNIT]
        changes = np.zeros(len(batch), bool)
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(changes), len(batch)]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            here = tuple(c[a] for c in columns)
            if rows and here != unit:
                yield rows
                rows = []
            unit = here
            rows.append(batch.slice(a, b - a))
    if rows:
        yield rows


def _columns(rows: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    return [np.concatenate([r[c].to_numpy(zero_copy_only=False) for r in rows]) for c in names]


def _partnered(units: DataFrame, radius: int, similarity: float) -> DataFrame:
    """The rows of units that have a partner by size and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches):
            second, fp, fp2, n, label = _columns(rows, "second", "fp", "fp2", "n", "label")
            fp, fp2 = fp.view(np.uint64), fp2.view(np.uint64)  # bits of signed numbers are counted without the sign
            one, two = np.flatnonzero(~second), np.flatnonzero(second)
            two = two if len(two) else one
            found = np.zeros(len(n), bool)
            for part in np.array_split(one, 1 + len(one) // ROWS):
                left, right = part[:, None], two[None, :]
                near = np.bitwise_count(fp[left] ^ fp[right]).astype(np.int16) + np.bitwise_count(fp2[left] ^ fp2[right]) <= radius
                low, high = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
                near = (near | (low < SHORT)) & (low >= similarity * high - 1e-9) & (label[left] != label[right])
                found[part] |= near.any(1)
                found[two] |= near.any(0)
            if found.any():
                table = pa.Table.from_batches(rows).select([*UNIT, "second", "set", "label"]).filter(pa.array(found))
                yield from table.to_batches()

    return units.select(*UNIT, "second", *MEMBER).mapInArrow(released(run), "key long, low long, high long, second boolean, set long, label long")


def _large(some: DataFrame, texts: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) of the larger shards, exact: they join all that any link in a shard joins."""
    members = materialize(_parts(some), "parts")
    parts = members.groupBy("key", "part").agg(F.min("label").alias("from"), F.max("label").alias("to"))
    one, two = (parts.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("part", "from", "to")]) for k in (1, 2))
    joined = (F.col("from1") == F.col("to1")) & (F.col("from2") == F.col("to2")) & (F.col("from1") == F.col("from2"))
    met = one.join(two, "key").where((F.col("part1") <= F.col("part2")) & ~joined).select("key", F.col("part1").alias("low"), F.col("part2").alias("high"))
    met = materialize(met, "met")
    side = lambda c, second: met.withColumns({"part": F.col(c), "second": F.lit(second)})
    rows = members.join(side("low", False).union(side("high", True).where("low <> high")), ["key", "part"])
    dealt = rows.repartition(*UNIT).sortWithinPartitions(*UNIT)
    asked = materialize(_partnered(dealt, radius, similarity), "asked")
    found = materialize(_shingles(texts, asked.select("set").distinct(), shingle), "shingles")
    units = asked.join(found, "set").repartition(*UNIT).sortWithinPartitions(*UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches):
            second, name, label = _columns(rows, "second", "set", "label")
            sets = [x for r in rows for x in np.split(r["shingles"].flatten().to_numpy(), np.cumsum(r["shingles"].value_lengths().to_numpy())[:-1])]
            one, two = np.flatnonzero(~second), np.flatnonzero(second)
            left = [sets[i] for i in one]
            if len(two):
                links = unit_links(left, [sets[i] for i in two], (label[one], label[two]), similarity)
            else:
                two, links = one, unit_links(left, None, (label, label), similarity)
            if links:
                a, b = (name[s[list(x)]] for s, x in zip((one, two), zip(*links), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    out = materialize(units.mapInArrow(released(run), "a long, b long").distinct(), "large")
    discard(members, met, asked, found)
    return out


def _across(members: DataFrame, texts: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) between members (key, set, fp, fp2, n, label) of a shard with different labels."""
    mixed = members.groupBy("key").agg(F.count("*").alias("all"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    some = materialize(members.join(mixed.select("key", "all"), "key"), "mixed")
    few = verified(_small(some, radius, similarity).distinct(), texts, shingle, similarity)
    many = _large(some, texts, shingle, radius, similarity)
    out = materialize(few.union(many), "across")
    discard(some, few, many)
    return out


def _chained(labelled: DataFrame, order: tuple[str, ...], radius: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of a member and the one before it in its shard that may be near copies.

    Members are dealt by ranges, so a shard of any size is spread; at the border
    of a range a pair is left to the next round.
    """
    dealt = labelled.where(F.pmod("key", F.lit(CHAINED)) == 0).select("key", *MEMBER).repartitionByRange("key", *order).sortWithinPartitions("key", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([last, batch] if last is not None else [batch]).combine_chunks()
            last = batch.slice(len(batch) - 1) if len(batch) else last
            key, name, fp, fp2, n, label = (rows[c].to_numpy() for c in ("key", *MEMBER))
            bits = sum(np.bitwise_count((x[1:] ^ x[:-1]).view(np.uint64)).astype(np.int16) for x in (fp, fp2))
            low, high = np.minimum(n[1:], n[:-1]), np.maximum(n[1:], n[:-1])
            near = (key[1:] == key[:-1]) & (label[1:] != label[:-1]) & ((bits <= radius) | (low < SHORT)) & (low >= similarity * high - 1e-9)
            a, b = name[:-1][near], name[1:][near]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return dealt.mapInArrow(released(run), "a long, b long").distinct()


def _members(each: DataFrame) -> DataFrame:
    """(key, set, fp, fp2, n) of all shards of two sets or more."""
    keyed = each.select("set", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("all")).where("all > 1").select("key")
    return keyed.join(shared, "key").join(each.select("set", "fp", "fp2", "n"), "set").select("key", "set", "fp", "fp2", "n")


def _labelled(members: DataFrame, linked: list[DataFrame]) -> DataFrame:
    """``members`` with the label of the component that the links make so far."""
    labels = connected_components(reduce(DataFrame.union, linked))
    return materialize(members.join(labels, members["set"] == labels["node"], "left").withColumn("label", F.coalesce("label", "set")).drop("node"), "labelled")


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(__id, __same, first) of each row: the smallest (id, same) of its component."""
    plain = docs.select(F.coalesce(F.col(id), F.lit(LAST_ID)).cast("long").alias("__id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("__same"), F.col(text).alias("__text"))
    made = materialize(_sets(plain, shingle, similarity), "sets")
    rows = materialize(made.select("__id", "__same", "set"), "rows")
    least = F.min(F.struct(F.col("__id").alias("id"), F.col("__same").alias("same"))).alias("least")
    each = materialize(made.groupBy("set").agg(least, *[F.first(c).alias(c) for c in ("fp", "fp2", "n", "keys")]), "distinct")
    discard(made)
    members = materialize(_members(each), "members")
    paired = _by_fingerprint(each)
    # one text of each set that has partners
    asked = members.select("set").union(paired.select("a")).union(paired.select("b")).distinct()
    some = asked.join(each, "set").select("set", F.col("least.id").alias("__id"), F.col("least.same").alias("__same"))
    texts = materialize(plain.join(some, ["__id", "__same"]).dropDuplicates(["__id", "__same"]).select("set", "__text"), "texts")

    linked = [verified(paired, texts, shingle, similarity)]
    discard(paired)
    labelled = _labelled(members, linked)
    for order in ORDERS:
        linked.append(verified(_chained(labelled, order, radius, similarity), texts, shingle, similarity))
        before, labelled = labelled, _labelled(members, linked)
        discard(before)
    second = _across(labelled, texts, shingle, radius, similarity)
    labels = connected_components(reduce(DataFrame.union, [*linked, second]))
    named = each.join(labels, each["set"] == labels["node"], "left").select("set", "least", F.coalesce("label", "set").alias("label"))
    named = materialize(named, "named")
    firsts = named.groupBy("label").agg(F.min("least").alias("first"))
    known = materialize(named.join(firsts, "label").select("set", "first"), "components")
    discard(each, members, texts, labelled, *linked, second, named)
    return rows.select("__id", "__same", "set").join(known, "set").select("__id", "__same", "first")


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component, unchanged.

    Of rows with the same id and text that differ elsewhere, any one stays.
    """
    found = near_copies(docs, id, text, similarity, shingle, radius)
    firsts = found.where((F.col("__id") == F.col("first.id")) & (F.col("__same") == F.col("first.same")))
    return one_row_each(docs, firsts.select(F.col("__id").alias("__key"), "__same"), id, text)
