"""Phrases that hold together, by hierarchical naming of adjacent pairs.

Words that a language has often enough get ids.  A phrase of k words is a pair
of adjacent ids of phrases of k-1 words that overlap in all but their ends, and
only pairs of frequent ids are counted, as a phrase is no more frequent than
its parts.  Frequent pairs get ids in turn, which replace them in the texts for
the next length.  The two ids of a pair are pointers to its parents: along them
come the counts of all its beginnings and ends, so of every cut, and each
phrase tells its parents that it holds them.

Texts are kept as blocks: a task numbers the distinct words (later, pairs) of
some texts of one language as it meets them and writes them in one row, with
their counts and the number at each place.  To count and to name, each distinct
one of a block is a row that goes to the task of its key; those of frequent keys
go back to their block with an id.  A common word is one row for each block, and
a text is moved as numbers only.

Defined results: a null text is empty, a null language is ``und`` and the same
as that one; repeated rows count again, copies as well; ties of a score go by
count and phrase; an empty table gives an empty one.  Only named columns are
read.  Scores are exact as long as a language has less than 10^15 words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

MIN_COUNT, LONGEST, COVERED_PERCENT, BEST = 10, 3, 50, 2000
#: Low bits of an id, which tell its task.
TASK_BITS = 20
#: Words of a block; bytes of a text that are split at once, up to the next break.
BLOCK, SLICE = 1 << 21, 1 << 22

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Capitals become small, a tab a space, and a break a full stop, which is never part of a word.
_PLAIN = bytes.maketrans(_BREAKS + _UPPER + b"\t", b"." * len(_BREAKS) + _LOWER + b" ")


class Numbering(dict):
    """Numbers new keys in turn; the break has -1."""

    def __init__(self):
        super().__init__({b".": -1})

    def __missing__(self, key: bytes) -> int:
        self[key] = found = len(self) - 1
        return found


def slices(text: bytes) -> Iterator[bytes]:
    """The text, plain, in stretches that end at a break."""
    text = text.translate(_PLAIN)
    at = 0
    while at < len(text):
        end = text.find(b".", at + SLICE)
        end = len(text) if end < 0 else end + 1
        yield text[at:end]
        at = end


def split_words(text: bytes) -> list[bytes]:
    """The words of a plain text, with a full stop for each break."""
    return text.replace(b".", b" . ").split()


def _packed(values: np.ndarray | list[bytes]) -> bytes:
    raw = values.tobytes() if isinstance(values, np.ndarray) else b"\n".join(values)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _raw(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _numbers(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_raw(packed), kind)


#: ``keys`` are the distinct words, or the ids left and right of distinct pairs; ``codes`` the number of one at each place.
_BLOCK = "block long, lang string, words long, keys binary, right binary, n binary, codes binary"
_NAMES = [f.split()[0] for f in _BLOCK.split(", ")]


def _block(*values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[f.split()[1]]) for v, f in zip(values, _BLOCK.split(", "), strict=True)], _NAMES)


def word_blocks(docs: DataFrame, text: str, lang: str, block_words: int = BLOCK) -> DataFrame:
    """Blocks of the words of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        blocks: dict[str, tuple[Numbering, list[np.ndarray]]] = {}
        held = 0

        def written() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for name, (known, parts) in blocks.items():
                codes = np.concatenate(parts)
                n = np.bincount(codes[codes >= 0], minlength=len(known) - 1)
                yield _block(number, name, int(n.sum()), _packed([w for w in known if known[w] >= 0]), None, _packed(n), _packed(codes))
                number += 1
            blocks.clear()

        for batch in batches:
            for name, t in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                for some in slices(t.as_py()):
                    known, parts = blocks.setdefault(name, (Numbering(), []))
                    words = split_words(some)
                    parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    parts.append(np.array([-1], np.int32))
                    held += len(words)
                    if held >= block_words:
                        yield from written()
                        held = 0
        yield from written()

    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return plain.where(F.length("text") > 0).mapInArrow(run, _BLOCK)


def _entries(blocks: DataFrame, of_words: bool) -> DataFrame:
    """A row for each distinct word or pair of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = _numbers(row["n"], np.int64)
                size = len(n)
                if not size:
                    continue
                if of_words:
                    keys = [pa.DictionaryArray.from_arrays(np.zeros(size, np.int32), pa.array([row["lang"]])).dictionary_decode(), pa.array(_raw(row["keys"]).split(b"\n"), pa.binary())]
                else:
                    keys = [pa.array(_numbers(row[c], np.int64)) for c in ("keys", "right")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(n), pa.array(np.full(size, row["block"])), pa.array(np.arange(size, dtype=np.int32))], names)

    key = _key(of_words)
    names = [*(k for k, _ in key), "n", "block", "code"]
    return blocks.select("block", "lang", "keys", "right", "n").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in key) + ", n long, block long, code int")


def _key(of_words: bool) -> list[tuple[str, str]]:
    return [("lang", "string"), ("word", "binary")] if of_words else [("left", "long"), ("right", "long")]


def _named(entries: DataFrame, of_words: bool, min_count: int, name: str) -> DataFrame:
    """The entries that occur often enough in all blocks together, with their count ``a`` and an id of their key.

    Rows of a key come one after the other, so ids are dealt in passing;
    ``leads`` marks one row of each.  As the table is written, ids stay.
    """
    key = [k for k, _ in _key(of_words)]
    often = entries.withColumn("a", F.sum("n").over(Window.partitionBy(*key))).where(F.col("a") >= min_count).drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # small numbers, as most ids have few high bits: those of a task come first
        task, dealt, last = TaskContext.get().partitionId(), -1, None
        if task >> TASK_BITS:
            raise ValueError(f"ids have room for {1 << TASK_BITS} tasks")
        for batch in batches:
            if not len(batch):
                continue
            leads = np.zeros(len(batch), bool)
            for k in key:
                leads[1:] |= np.asarray(pc.not_equal(batch[k].slice(1), batch[k].slice(0, len(batch) - 1)))
            leads[0] = tuple(batch[k][0].as_py() for k in key) != last
            last = tuple(batch[k][len(batch) - 1].as_py() for k in key)
            number = dealt + np.cumsum(leads)
            dealt = int(number[-1])
            yield batch.append_column("id", pa.array(number << TASK_BITS | task)).append_column("leads", pa.array(leads))

    schema = ", ".join([*(f"{k} {t}" for k, t in _key(of_words)), "block long, code int, a long, id long, leads boolean"])
    return materialize(often.select(*key, "block", "code", "a").mapInArrow(run, schema), name)


def _counted(entries: DataFrame, min_count: int, name: str) -> DataFrame:
    """(left, right, a) of the pairs that occur often enough, one row each: those of the last length go back to no block."""
    return materialize(entries.groupBy("left", "right").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count), name)


def pairs_of(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a block and their ids (-1 for none) to its adjacent pairs of ids: (left, right, count, numbers at each place)."""
    size = len(ids)
    known = (codes >= 0) & (ids[codes] >= 0)
    here = np.flatnonzero(known[:-1] & known[1:])
    keys, at, counts = np.unique(codes[here].astype(np.int64) * size + codes[here + 1], return_inverse=True, return_counts=True)
    out = np.full(max(len(codes) - 1, 0), -1, np.int32)
    out[here] = at
    return ids[keys // size], ids[keys % size], counts, out


def pair_blocks(blocks: DataFrame, named: DataFrame, last: bool) -> DataFrame:
    """Blocks of the next length; ``named`` has (block, code, id) of what is frequent.  The ``last`` ones have no places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(row: dict, at: list[np.ndarray], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if found:
                codes = _numbers(row["codes"], np.int32)
                ids = np.full(codes.max(initial=-1) + 2, -1, np.int64)
                ids[np.concatenate(at)] = np.concatenate(found)
                left, right, counts, places = pairs_of(codes, ids)
                if len(left):
                    yield _block(row["block"], row["lang"], 0, _packed(left), _packed(right), _packed(counts), None if last else _packed(places))

        row, at, found = {"block": None}, [], []
        for batch in batches:
            column = batch["block"].to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(column)) + 1), len(column)]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if row["block"] != column[a]:
                    yield from made(row, at, found)
                    # the row with the places comes first
                    row, at, found = rows.slice(0, 1).to_pylist()[0], [], []
                    rows = rows.slice(1)
                if len(rows):
                    at.append(rows["code"].to_numpy())
                    found.append(rows["id"].to_numpy())
        yield from made(row, at, found)

    places = blocks.select("block", F.lit(-1).alias("code"), F.lit(None).cast("long").alias("id"), "lang", "codes")
    both = places.union(named.select("block", "code", "id", F.lit(None).cast("string"), F.lit(None).cast("binary")))
    return both.repartition("block").sortWithinPartitions("block", "code").mapInArrow(run, _BLOCK)


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, block_words: int = BLOCK
) -> tuple[list[DataFrame], DataFrame]:
    """A table for each number of words, from one on, and the number of all words (lang, n).

    (lang, id, left, right, a, phrase, last, starts, ends): ``left`` and
    ``right`` are the ids of the phrase without its last and first word;
    ``starts`` and ``ends`` are the counts of its first and last 1, 2, ... words.
    """
    blocks = materialize(word_blocks(docs, text, lang, block_words), "words")
    totals = materialize(blocks.groupBy("lang").agg(F.sum("words").alias("n")).where("n > 0"), "totals")
    named = _named(_entries(blocks, True), True, min_count, "named")
    word = F.col("word").cast("string")
    none = F.lit(None).cast("long")
    first = named.where("leads").select("lang", "id", none.alias("left"), none.alias("right"), "a", word.alias("phrase"), word.alias("last"), F.array("a").alias("starts"), F.array("a").alias("ends"))
    levels = [materialize(first, "phrases1")]
    for k in range(2, longest + 1):
        following = materialize(pair_blocks(blocks, named, last=k == longest), f"pairs{k}")
        discard(blocks, named)
        blocks = following
        entries = _entries(blocks, False)
        if k < longest:
            named = _named(entries, False, min_count, f"named{k}")
            found = named.where("leads")
        else:
            # no longer phrase points to these, so they have no ids
            named = _counted(entries.select("left", "right", "n"), min_count, f"counted{k}")
            found = named.withColumn("id", none)
        left, right = (levels[-1].select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "lang", "phrase", "last", "starts", "ends")]) for side in "lr")
        grown = found.join(left, F.col("left") == F.col("l_id")).join(right, F.col("right") == F.col("r_id"))
        levels.append(
            materialize(
                grown.select(
                    F.col("l_lang").alias("lang"),
                    "id",
                    "left",
                    "right",
                    "a",
                    F.concat_ws(" ", "l_phrase", "r_last").alias("phrase"),
                    F.col("r_last").alias("last"),
                    F.concat("l_starts", F.array("a")).alias("starts"),
                    F.concat("r_ends", F.array("a")).alias("ends"),
                ),
                f"phrases{k}",
            )
        )
    discard(blocks, named)
    return levels, totals


def weakest_cut(length: int) -> Column:
    """(score, k, l, r) of the cut of a phrase of so many words whose score is the lowest."""
    cuts = []
    for k in range(1, length):
        left, right = F.col("starts")[k - 1], F.col("ends")[length - k - 1]
        # at most 10^36, which a decimal holds exactly
        exact = "CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))"
        score = F.expr(f"({exact}) DIV (CAST(starts[{k - 1}] AS DECIMAL(15, 0)) * CAST(ends[{length - k - 1}] AS DECIMAL(15, 0)))")
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    covered_percent: int = COVERED_PERCENT,
    best: int = BEST,
    block_words: int = BLOCK,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of two to ``longest`` words of each language.

    A phrase goes if a longer one that holds it has ``covered_percent`` of its
    count.  A phrase in between has at least that count, too, so it is enough
    to ask those of one word more.
    """
    levels, totals = frequent_phrases(docs, text, lang, min_count, longest, block_words)
    kept = []
    for k in range(2, longest + 1):
        some = levels[k - 1].select("lang", "id", "phrase", "a", weakest_cut(k).alias("cut"))
        if k < longest:
            above = levels[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("longer"))
            above = above.groupBy("id").agg(F.max("longer").alias("longer"))
            some = some.join(above, "id", "left").where(F.coalesce(100 * F.col("longer") < covered_percent * F.col("a"), F.lit(True)))
        kept.append(some.select("lang", "phrase", "a", "cut"))
    place = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = reduce(DataFrame.union, kept).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
