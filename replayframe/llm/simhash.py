"""SimHash near-duplicates, searched with BK-trees.

Fingerprints take 64 bits from the XXH64 values of a text's word shingles.  Of
the four 16-bit bands of two fingerprints that differ in at most two bits, two
bands are equal; each pair of bands therefore names the shards that can hold a
partner.  In a shard the distinct fingerprints stand in a BK-tree, whose
children are keyed by their Hamming distance to the parent, and a search
follows only the edges within the radius.

A tree goes to the tasks that search it and to no others: a shard of more than
``SHARD`` fingerprints is split, and the tree of each part is sent to every
part that must be searched in it.  Trees of all fingerprints are never sent to
all executors, as they grow with the corpus.  A shard passes on only as many
links as join its members, so a dense group costs no more rows than it has
members.  Before a large shard is split in parts, it is dealt anew by pairs of
four bands of the bits that its key leaves open, of which two are equal, too.

Defined results: a null or empty text has the fingerprint zero, which links
like any other; equal texts share a fingerprint; a null doc_id takes no part in
the smallest doc_id of a component (null if there is no other); repeated rows
each have their row; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LAST_ID, discard, fields, materialize, released, struct_of
from .components import connected_components

RADIUS = 2
SHINGLE = 3
#: Fingerprints of one BK-tree.
SHARD = 1024
BANDS, BAND_BITS = 4, 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()  # bytes split at exactly the six ASCII white-space characters
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        hashes = [xxh64_intdigest(b" ".join(x), 42) for x in zip(*(words[k:] for k in range(shingle)))]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def add_simhash(docs: DataFrame, text: str = "text", name: str = "__fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a (signed) long."""
    rows = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[text].cast(pa.binary()).to_pylist()
            found = np.array([simhash(x or b"", shingle) for x in texts], np.uint64).view(np.int64)
            yield batch.append_column(name, pa.array(found))

    return rows.mapInArrow(released(run), StructType([*rows.schema.fields, StructField(name, LongType())]))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


class BKTree:
    """Integers under Hamming distance; a node is (value, children by distance)."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            here, children = todo.pop()
            d = (here ^ value).bit_count()
            if d <= radius:
                yield here
            if children:
                for k in range(max(1, d - radius), d + radius + 1):
                    if k in children:
                        todo.append(children[k])


class Forest:
    """Which members are joined so far; ``join`` tells whether a link is news."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.top(x), self.top(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


MASK = (1 << 64) - 1


def search(rows: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Links of one unit; rows (fingerprint, role): 0 tree, 1 searched in it, 2 both."""
    tree, joined, out = BKTree(), Forest(), []
    for value, role in rows:
        if role:
            out += [(x, value) for x in tree.within(value, radius) if x != value and joined.join(x, value)]
        if role != 1:
            tree.add(value)
    return out


def _finer(band: list[Column]) -> Column:
    """Keys within a shard: two equal bands of eight bits among the two bands that its key doesn't name."""
    pairs = list(combinations(range(BANDS), 2))
    open_ = [[k for k in range(BANDS) if k not in pair] for pair in pairs]
    rest = F.get(F.array(*[band[a] * F.lit(1 << BAND_BITS) + band[b] for a, b in open_]), F.shiftright("key", 2 * BAND_BITS).cast("int"))
    eight = [F.shiftrightunsigned(rest, 8 * k).bitwiseAND(255) for k in range(4)]
    return F.array(*[F.xxhash64("key", F.lit(n), eight[a], eight[b]) for n, (a, b) in enumerate(combinations(range(4), 2))])


def links(fingerprints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Distinct longs ``fp`` to links (a, b) that connect all within the radius."""
    if radius > BANDS - 2:
        raise ValueError(f"two equal bands are sure up to a radius of {BANDS - 2}")
    band = [F.shiftrightunsigned("fp", BAND_BITS * k).bitwiseAND((1 << BAND_BITS) - 1) for k in range(BANDS)]
    keys = F.array(
        *[F.lit(n << 2 * BAND_BITS) + band[a] * F.lit(1 << BAND_BITS) + band[b] for n, (a, b) in enumerate(combinations(range(BANDS), 2))]
    )
    keyed = fingerprints.select("fp", F.explode(keys).alias("key"))
    counts = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    shared = keyed.join(counts, "key")
    few = shared.where(F.col("n") <= shard).select("fp", "key", F.lit(1).alias("parts"))
    again = shared.where(F.col("n") > shard).select("fp", F.explode(_finer(band)).alias("key"))
    sizes = again.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    many = again.join(sizes, "key").select("fp", "key", F.ceil(F.col("n") / shard).cast("int").alias("parts"))
    units = (
        few.union(many)
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "fp",
            "key",
            F.least("part", "other").alias("low"),
            F.greatest("part", "other").alias("high"),
            F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("role"),
        )
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "role", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "low", "high", "fp", "role")
        stream = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in names)))
        for _, rows in groupby(stream, key=lambda r: r[:3]):
            unit = [(r[3] & MASK, r[4]) for r in rows]
            if found := search(unit, radius):
                both = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    out = materialize(units.mapInArrow(released(run), "a long, b long").distinct(), "links")
    discard(counts)
    return out


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, __same, __fp, component_id, __first) of each row of ``docs``.

    ``__same`` is a hash of the text; ``__first`` marks the rows of the one
    document that stands for its component, the smallest (id, __same).
    """
    plain = docs.select(F.col(id).alias("__id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("__same"), F.col(text).alias("__text"))
    rows = materialize(add_simhash(plain, "__text", "__fp", shingle).drop("__text"), "fingerprints")
    ranked = F.struct(F.coalesce("__id", F.lit(LAST_ID)).alias("id"), F.col("__same").alias("same"), F.col("__id").alias("own"))
    each = materialize(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(ranked).alias("least")), "distinct")
    edges = links(each.select("fp"), radius)
    labels = connected_components(edges)
    linked = materialize(each.join(labels, each.fp == labels.node).select("fp", "label", "least"), "linked")
    firsts = linked.groupBy("label").agg(F.min("least").alias("first"))
    moved = linked.join(firsts, "label").select(F.col("fp").alias("moved"), "first")
    known = materialize(
        each.join(moved, each.fp == F.col("moved"), "left").select("fp", F.coalesce("first", "least").alias("first")), "components"
    )
    discard(each, edges, linked)
    return rows.join(known, rows["__fp"] == known["fp"]).select(
        F.col("__id").alias(id),
        "__same",
        "__fp",
        F.col("first.own").alias("component_id"),
        (F.col("__id").eqNullSafe(F.col("first.own")) & (F.col("__same") == F.col("first.same"))).alias("__first"),
    )


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component, unchanged.

    Of rows with the same id and text that differ elsewhere, any one stays.
    """
    found = near_duplicates(docs, id, text, radius, shingle)
    return one_row_each(docs, found.where("__first").select(F.col(id).alias("__key"), "__same"), id, text)


def one_row_each(docs: DataFrame, kept: DataFrame, id: str, text: str) -> DataFrame:
    """One row of ``docs`` for each (__key, __same) of ``kept``: an id, null or the last for none, and the hash of a text."""
    kept = materialize(kept.select(F.coalesce("__key", F.lit(LAST_ID)).cast("long").alias("__key"), "__same").distinct(), "kept")
    keyed = docs.select(
        struct_of(docs).alias("__row"), F.coalesce(F.col(id), F.lit(LAST_ID)).cast("long").alias("__key"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("__same")
    )
    return keyed.join(kept, ["__key", "__same"], "left_semi").dropDuplicates(["__key", "__same"]).select(*fields(docs))
