"""Line dedup with a log-template tree.

The tree has a fixed depth: a line goes down by its number of tokens and by its
``DEPTH`` leading tokens, where tokens with digits count as the variable ``<*>``.
In a leaf, a token that fewer than ``least_texts`` texts have at its place is
variable too; the constant ones make a template of a line, if they are at
least the share ``SIMILAR`` of it.  As values of a field reach any number of
texts in a large corpus, a line has further templates, in which a token is
constant only from a share of its leaf's texts on (``SHARES``).  A template
recurs when ``least_texts`` different texts have it.  Its lines are dropped from
all of them but the one with the smallest doc_id, which keeps its own.

Lines that are identical but for numbers need fewer texts the longer they are:
``least_identical``, from ten for four words down to two for twenty.

Leaves and templates are counted by aggregation, never gathered; leaves that
few texts reach are left out before tokens are looked at.  Exact copies of a
text count once and lose the same lines, so near-dedup can follow; on demand
near copies (five-word shingles, similarity 0.8) are left to it in the same way.

Defined results: a null or empty text stays as it is; lines of fewer than
``LEAST_TOKENS`` words never go; a text that loses all its lines becomes empty,
and the row stays; a null doc_id comes after all others; repeated rows get equal
results; other columns pass through, and ``n_chars``, where there is one,
follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, discard, materialize, released, struct_of
from .components import connected_components
from .near_copies import verified

#: Leading tokens that a line goes down by.
DEPTH = 3
LEAST_TOKENS, LEAST_TEXTS = 3, 10
#: Words that all texts of an identical line must hold together, if these are fewer than LEAST_TEXTS.
IDENTICAL_WORDS = 40
SIMILAR = 0.5
#: A line has a template for each of these shares of its leaf's texts that its constant tokens must be in.
SHARES = (0.0, 0.1, 0.5, 0.9)
#: Up to so many rows of a few longs, a table goes to all executors; beyond, it is shuffled.
SMALL = 1_000_000
#: From this share of its words on that a text would lose to one other, it is asked whether it is a copy of that one.
SHARED = 0.05
VARIABLE = b"<*>"
_DIGITS = b"0123456789"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def tokens(line: bytes) -> list[bytes]:
    """The words of a line, those with digits as the variable."""
    words = line.split()
    if line.translate(None, _DIGITS) == line:
        return words
    return [w if w.translate(None, _DIGITS) == w else VARIABLE for w in words]


def _hash(parts: list[bytes]) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(b" ".join(parts), len(parts))
    return x - (1 << 64) if x >> 63 else x


def _lines(text: bytes | None) -> Iterator[tuple[bytes, list[bytes]]]:
    for line in (text or b"").split(b"\n"):
        found = tokens(line)
        if len(found) >= LEAST_TOKENS:
            yield line, found


def least_identical(n: Column, least_texts: int = LEAST_TEXTS) -> Column:
    """The texts that an identical line of ``n`` words needs to recur."""
    return F.least(F.lit(least_texts), F.greatest(F.lit(2), F.ceil(IDENTICAL_WORDS / n))).cast("long")


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _leaf(found: list[bytes]) -> int:
    return _hash([str(len(found)).encode(), *found[:DEPTH]])


def _identical(plain: DataFrame, least_texts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(__same, line, words, first): the identical lines that enough texts have, without the ``first`` of these;
    the lines of all texts, with the words of the whole text; and the lines that recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            row, line, n, whole = [], [], [], []
            for k, t in enumerate(batch["__text"].cast(pa.binary()).to_pylist()):
                parts = [(_hash(x), len(x)) for _, x in _lines(t)]
                found = dict(parts)
                row += [k] * len(found)
                line += found
                n += found.values()
                whole += [sum(w for _, w in parts)] * len(found)
            pick = pa.array(row, pa.int32())
            columns = [batch["__id"].take(pick), batch["__same"].take(pick), pa.array(line, pa.int64()), pa.array(n, pa.int32()), pa.array(whole, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "__same", "line", "words", "whole"])

    each = plain.mapInArrow(released(run), "__id long, __same long, line long, words int, whole int").groupBy("line", "__same")
    each = materialize(each.agg(F.min("__id").alias("__id"), F.first("words").alias("words"), F.max("whole").alias("whole")), "identical")
    counts = each.groupBy("line").agg(F.count("*").alias("n"), F.first("words").alias("words"), F.min(F.struct("__id", "__same")).alias("least"))
    often = counts.where((F.col("n") > 1) & (F.col("n") >= least_identical(F.col("words"), least_texts)))
    often = materialize(often.select("line", F.col("least.__same").alias("first")), "often")
    return each.join(_small(often), "line").where("__same <> first").select("__same", "line", "words", "first"), each, often


def _copies(lost: DataFrame, each: DataFrame, plain: DataFrame) -> DataFrame:
    """(a, b): texts that would lose lines to the texts of which they are near copies."""
    shared = lost.groupBy("__same", "first", "line").agg(F.max("words").alias("words")).groupBy("__same", "first").agg(F.sum("words").alias("words"))
    most = shared.groupBy("__same").agg(F.max(F.struct("words", "first")).alias("most"))
    whole = each.groupBy("__same").agg(F.max("whole").alias("whole"))
    pairs = most.join(whole, "__same").where(F.col("most.words") >= SHARED * F.col("whole"))
    pairs = materialize(pairs.select(F.col("__same").alias("a"), F.col("most.first").alias("b")), "asked")
    asked = pairs.select(F.col("a").alias("__same")).union(pairs.select("b")).distinct()
    texts = plain.join(asked, "__same", "left_semi").groupBy(F.col("__same").alias("set")).agg(F.first("__text").alias("__text"))
    texts = materialize(texts, "texts")
    out = verified(pairs, texts)
    discard(pairs, texts)
    return out


def recurring_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least_texts: int = LEAST_TEXTS, spare_copies: bool = False) -> DataFrame:
    """(__same, lines): hashes of the lines that the texts with the hash ``__same`` lose.

    With ``spare_copies`` a near copy loses no lines to the texts that it is
    linked with, but the same lines as these to all others.
    """
    plain = docs.select(F.coalesce(F.col(id), F.lit(LAST_ID)).cast("long").alias("__id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("__same"), F.col(text).alias("__text"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            texts, leaf = [], []
            for s, t in zip(batch["__same"].to_pylist(), batch["__text"].cast(pa.binary()).to_pylist()):
                found = {_leaf(x) for _, x in _lines(t)}
                texts += [s] * len(found)
                leaf += found
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(leaf, pa.int64())], ["__same", "leaf"])

    reached = plain.mapInArrow(released(leaves), "__same long, leaf long").distinct().groupBy("leaf").agg(F.count("*").alias("n"))
    full = materialize(reached.where(F.col("n") >= least_texts).select("leaf"), "leaves")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            row, leaf, line, content = [], [], [], []
            for k, t in enumerate(batch["__text"].cast(pa.binary()).to_pylist()):
                for x, found in _lines(t):
                    row.append(k)
                    leaf.append(_leaf(found))
                    line.append(_hash(found))
                    content.append(x)
            pick = pa.array(row, pa.int32())
            columns = [batch["__id"].take(pick), batch["__same"].take(pick), pa.array(leaf, pa.int64()), pa.array(line, pa.int64()), pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "__same", "leaf", "line", "content"])

    found = plain.mapInArrow(released(members), "__id long, __same long, leaf long, line long, content binary").join(_small(full), "leaf", "left_semi")
    found = materialize(found, "members")
    # texts that have a line, the copies of a text as one
    having = materialize(found.groupBy("line", "__same").agg(F.min("__id").alias("__id")), "having")
    each = having.groupBy("line").agg(F.count("*").alias("n"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            split = [[_hash([w]) for w in tokens(x)] for x in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["line"], batch["leaf"], pa.array(split, pa.list_(pa.int64()))], ["line", "leaf", "tokens"])

    distinct = found.groupBy("line").agg(F.min("leaf").alias("leaf"), F.min("content").alias("content")).select("line", "leaf", "content")
    lines = materialize(distinct.mapInArrow(released(shapes), "line long, leaf long, tokens array<long>").join(each, "line"), "lines")
    places = lines.select("leaf", "line", "n", F.size("tokens").alias("length"), F.posexplode("tokens").alias("place", "token"))
    constant = places.groupBy("leaf", "place", "token").agg(F.sum("n").alias("texts")).where(F.col("texts") >= least_texts)
    # a place is in every line of its leaf
    whole = lines.groupBy("leaf").agg(F.sum("n").alias("whole"))
    constant = constant.join(_small(whole), "leaf").select("leaf", "place", "token", (F.col("texts") / F.col("whole")).alias("share"))
    shaped = (
        places.join(constant, ["leaf", "place", "token"])
        .groupBy("line")
        .agg(F.first("length").alias("length"), F.first("leaf").alias("leaf"), F.sort_array(F.collect_list(F.struct("place", "token", "share"))).alias("found"))
        .where(F.size("found") >= SIMILAR * F.col("length"))
    )

    def constants(share: float):
        return F.transform(F.filter("found", lambda x: x["share"] >= share), lambda x: F.struct(x["place"], x["token"]))

    # lines whose templates are the same by all shares have one
    options = F.array_distinct(F.array(*[constants(s) for s in SHARES]))
    templates = materialize(
        shaped.select("line", "length", "leaf", F.explode(options).alias("constant"))
        .where(F.size("constant") >= SIMILAR * F.col("length"))
        .select("line", F.col("length").alias("words"), F.xxhash64("leaf", "constant").alias("template")),
        "templates",
    )
    matched = having.join(_small(templates), "line")
    texts = matched.groupBy("template", "__same").agg(F.min("__id").alias("__id"))
    recurring = texts.groupBy("template").agg(F.count("*").alias("n"), F.min(F.struct("__id", "__same")).alias("first"))
    recurring = materialize(recurring.where(F.col("n") >= least_texts).select("template", F.col("first.__same").alias("first")), "recurring")
    lost = matched.join(_small(recurring), "template").where("__same <> first").select("__same", "line", "words", "first")
    alike, each, often = _identical(plain, least_texts)
    lost = lost.union(alike)
    tables = [full, found, having, lines, templates, recurring, each, often]
    if spare_copies:
        lost = materialize(lost, "found")
        links = _copies(lost, each, plain)
        groups = materialize(connected_components(links), "groups")
        of = lambda name: groups.select(F.col("node").alias(name), F.col("label").alias(f"group_{name}"))
        grouped = lost.join(of("__same"), "__same", "left").join(of("first"), "first", "left")
        outside = F.coalesce("group___same", "__same") != F.coalesce("group_first", "first")
        tables += [lost, links, groups]
        lost = grouped.where(outside)
    out = materialize(lost.groupBy("__same").agg(F.collect_set("line").alias("lines")), "lost")
    discard(*tables)
    return out


def drop_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least_texts: int = LEAST_TEXTS, spare_copies: bool = False) -> DataFrame:
    """(__row, __kept, __lines, __dropped): each row, its text without recurring lines, and counts of lines."""
    lost = recurring_lines(docs, id, text, least_texts, spare_copies)
    keyed = docs.select(struct_of(docs).alias("__row"), F.col(text).alias("__text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("__same"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            kept, n, dropped = [], [], []
            for t, gone in zip(batch["__text"].cast(pa.binary()).to_pylist(), batch["lines"].to_pylist()):
                lines, gone = (t or b"").split(b"\n"), set(gone or ())
                stay = [x for x in lines if not gone or len(y := tokens(x)) < LEAST_TOKENS or _hash(y) not in gone]
                kept.append(t if len(stay) == len(lines) else b"\n".join(stay))
                n.append(sum(1 for x in lines if x.split()))
                dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch["__row"], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], ["__row", "__kept", "__lines", "__dropped"])

    # what texts lose grows with the corpus: always merged, never broadcast on an estimate
    joined = keyed.join(lost.hint("merge"), "__same", "left").select("__row", "__text", "lines")
    return joined.mapInArrow(released(cut), joined.select("__row").schema.add("__kept", "string").add("__lines", "long").add("__dropped", "long"))


def without_recurring_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least_texts: int = LEAST_TEXTS, spare_copies: bool = False) -> DataFrame:
    """``docs`` with shorter texts."""
    values = {text: F.col("__kept")}
    if "n_chars" in docs.columns:
        size = F.length("__kept").cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(F.col("__dropped") > 0, size).otherwise(F.col("__row")["n_chars"])
    return drop_lines(docs, id, text, least_texts, spare_copies).select(*[values.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])
