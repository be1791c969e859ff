"""BPE encoding and decoding by tree concatenation.

A text is halved again and again, without looking for white space, into pieces
of at most ``piece_chars``; the pieces are encoded each for itself, and the
tree is folded back by re-encoding a growing window around each join until its
tokens agree with those of the left half and with those of the right half.
Pieces of a text of more than ``spread_chars`` are dealt over the cluster and
encoded in parallel; smaller texts are folded by the task that reads them, and
nothing is shuffled.

Where white space always ends a token, which a few probes of the tokenizer
show, each distinct word of a piece is encoded once and remembered; runs too
long to be remembered are encoded token by token, and joins inside them are
found between tokens, as are all joins of other tokenizers.

Defined results: a null or empty text has no tokens and decodes to the empty
string; repeated rows get equal results; an empty table gives an empty one;
other columns pass through untouched, whatever their names, and a column of
theirs that has the name of a result is replaced.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import fields, released, struct_of

#: Characters of a piece, the leaf of a tree.
PIECE_CHARS = 16_384
#: Texts of more characters are encoded by several tasks.
SPREAD_CHARS = 1 << 20
#: Characters that a seam keeps from the edges of what was encoded; no added
#: token and no composed character is as long.
MARGIN = 32
#: Equal neighbouring tokens that make a seam inside one unsplit run.
AGREE = 8
#: Distinct words that one Python worker remembers, and characters of the longest.
REMEMBERED, LONGEST = 300_000, 64
#: Texts that are encoded at once.
BATCH = 200

_BREAK = re.compile(r"[\x20\x09-\x0D]+")
_CONTROLS = re.compile(r"[\x1c-\x1f]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A small letter in front of a mark; one that is small in two characters, like a dotted capital I, tells nothing.
_LETTER = re.compile("[a-\u024f]\\Z")


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def _memory(path: str) -> dict[str, bytes]:
    return {"": b""}


#: Texts that show how a tokenizer treats white space, case and marks.
_PROBES = ("Hello", "WORLD", "Mixed Case words, and marks. Here", "x", "A", "it's DON'T", "Naive 12th B2B", "end. Next", "a,b. c", "Zq-Xj qqq")


@cache
def _habits(path: str) -> tuple[bool, bool]:
    """Whether white space always ends a token, and whether ASCII case and marks behind a letter can be split off."""

    def ids(x: str) -> list[int]:
        return tokenizer(path).encode(x, add_special_tokens=False).ids

    spaced = [(x, f"  {x} \t{y}\n ") for x in _PROBES for y in _PROBES]
    split = all(ids(x) == [i for w in _WORD.findall(x) for i in ids(w)] for both in spaced for x in both)
    lower = split and all(ids(w) == ids(w.lower()) and ids(f"{w}.") == ids(w) + ids(".") and ids(f"{w},") == ids(w) + ids(",") for x in _PROBES for w in re.findall(r"[A-Za-z']*[A-Za-z]", x))
    return split, lower


def split_words(text: str) -> list[str]:
    """The text at white space, which no token crosses."""
    # str.split is faster, but takes four control characters for white space
    return _BREAK.split(text) if _CONTROLS.search(text) else text.split()


def _plain(path: str, words: set[str]) -> tuple[dict[str, str], dict[str, tuple[str, str]]]:
    """Words as ones in lower case, and those that a full stop or comma ends as both parts, if the tokenizer doesn't mind.

    Added tokens, which hold ``<|``, are left alone.
    """
    if not _habits(path)[1]:
        return {w: w for w in words}, {}
    whole, marked = {}, {}
    for w in words:
        ascii = w.isascii()
        if "<|" in w:
            whole[w] = w
        elif w[-1] in ".," and len(w) > 1 and (w[-2].isalpha() if ascii else _LETTER.match(w[-2].lower()) and w[-2].isalpha()):
            base = w[:-1]
            marked[w] = (base.lower() if ascii else base), w[-1]
        else:
            whole[w] = w.lower() if ascii else w
    return whole, marked


def learn_words(path: str, words: set[str]) -> dict[str, bytes]:
    """Encode the words that aren't known yet; ids are kept as bytes of int32."""
    known = _memory(path)
    new = words.difference(known)  # a set minus a view would walk all that is known
    if len(known) + len(new) > REMEMBERED:
        kept = {w: known[w] for w in words if w in known and len(w) <= LONGEST}
        known.clear()
        known.update(kept)
        known[""] = b""
    whole, marked = _plain(path, new)
    bases = {*whole.values(), *(base for base, _ in marked.values())}
    bases = list((bases | {mark for _, mark in marked.values()}).difference(known))
    found = tokenizer(path).encode_batch_fast(bases, add_special_tokens=False)
    known.update(zip(bases, [array("i", e.ids).tobytes() for e in found]))
    for w, base in whole.items():
        known[w] = known[base]
    for w, (base, mark) in marked.items():
        known[w] = known[base] + known[mark]
    return known


#: What seams are found between: start and end in the text, ids as bytes, and
#: whether it begins a word.  Mostly a word; in long runs a single token.
Unit = tuple[int, int, bytes, bool]


def encode_piece(path: str, text: str, at: int = 0) -> list[Unit]:
    if not _habits(path)[0]:  # tokens may hold white space: seams are found between any
        e = tokenizer(path).encode(text, add_special_tokens=False)
        return [(x + at, y + at, np.int32(i).tobytes(), False) for (x, y), i in zip(e.offsets, e.ids)]
    spans = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    known = learn_words(path, {w for _, _, w in spans if len(w) <= LONGEST})
    out: list[Unit] = []
    for a, b, w in spans:
        if len(w) <= LONGEST:
            out.append((a + at, b + at, known[w], True))
            continue
        e, before = tokenizer(path).encode(w, add_special_tokens=False), None
        for (x, y), i, n in zip(e.offsets, e.ids, e.word_ids):
            out.append((a + at + x, a + at + y, np.int32(i).tobytes(), n != before))
            before = n
    return out


def _seam(one: list[Unit], two: list[Unit], low: int, high: int) -> tuple[int, int] | None:
    """Places in both lists from which they go on alike, between low and high."""
    starts = {}
    for k, x in enumerate(one):
        if x[3] and low <= x[0] <= high:
            starts[x[0]] = k
    for k, x in enumerate(two):
        if x[3] and x[0] in starts:
            return starts[x[0]], k
    # no word begins here in both: tokens that are alike inside one run
    inside = {}
    for k in range(len(one) - AGREE):
        if low <= one[k][0] and one[k + AGREE - 1][1] <= high:
            inside[one[k][:3]] = k
    for k in range(len(two) - AGREE):
        j = inside.get(two[k][:3])
        if j is not None and all(a[:3] == b[:3] for a, b in zip(one[j : j + AGREE], two[k : k + AGREE])):
            return j + AGREE // 2, k + AGREE // 2
    return None


def _near(units: list[Unit], low: int, high: int) -> tuple[int, list[Unit]]:
    """The units that begin in [low, high), and the place of the first."""
    a = bisect_left(units, (low,))
    return a, units[a : bisect_left(units, (high,))]


def join(path: str, text: str, left: list[Unit], right: list[Unit], a: int, m: int, b: int) -> list[Unit]:
    """The units of text[a:b] from those of text[a:m] and of text[m:b]."""
    width = 4 * MARGIN
    while True:
        low, high = max(a, m - width), min(b, m + width)
        window = encode_piece(path, text[low:high], low)
        before: tuple[int, int] | None = (0, 0)
        after: tuple[int, int] | None = (len(right), len(window))
        if low > a:
            k, part = _near(left, low + MARGIN, m - MARGIN)
            found = _seam(part, window, low + MARGIN, m - MARGIN)
            before = found and (found[0] + k, found[1])
        if high < b:
            k, part = _near(right, m + MARGIN, high - MARGIN)
            found = _seam(part, window, m + MARGIN, high - MARGIN)
            after = found and (found[0] + k, found[1])
        if before and after and before[1] <= after[1]:
            return left[: before[0]] + window[before[1] : after[1]] + right[after[0] :]
        width *= 2


def cuts(n: int, piece_chars: int = PIECE_CHARS) -> list[tuple[int, int]]:
    """The leaves of the tree of halves over n characters, in text order."""
    done, open_ = [], [(0, n)]
    while open_:
        a, b = open_.pop()
        if b - a <= piece_chars:
            done.append((a, b))
        else:
            m = (a + b) // 2
            open_ += [(m, b), (a, m)]
    return done


def fold(path: str, text: str, leaves: dict[int, list[Unit]], piece_chars: int) -> bytes:
    """Fold the encoded leaves up the same tree of halves; ids as bytes."""

    def part(a: int, b: int) -> list[Unit]:
        if b - a <= piece_chars:
            return leaves[a]
        m = (a + b) // 2
        return join(path, text, part(a, m), part(m, b), a, m, b)

    return b"".join([x[2] for x in part(0, len(text))])


def encode_tree(path: str, text: str, piece_chars: int = PIECE_CHARS) -> bytes:
    leaves = {a: encode_piece(path, text[a:b], a) for a, b in cuts(len(text), piece_chars)}
    return fold(path, text, leaves, piece_chars)


def encode_texts(path: str, texts: list[str], piece_chars: int = PIECE_CHARS) -> list[bytes]:
    """The ids of each text, as bytes of int32."""
    if not _habits(path)[0]:
        short = tokenizer(path).encode_batch_fast([x if len(x) <= piece_chars else "" for x in texts], add_special_tokens=False)
        return [array("i", e.ids).tobytes() if len(x) <= piece_chars else encode_tree(path, x, piece_chars) for x, e in zip(texts, short)]
    split = [split_words(x) if len(x) <= piece_chars else None for x in texts]
    known = learn_words(path, {w for ws in split if ws for w in ws})
    done = [b"".join(map(known.__getitem__, ws)) if ws is not None else None for ws in split]
    return [encode_tree(path, x, piece_chars) if found is None else found for x, found in zip(texts, done)]


def bpe_encode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    piece_chars: int = PIECE_CHARS,
    spread_chars: int = SPREAD_CHARS,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``ids``, the token ids of each whole text; the text itself goes if it isn't kept."""
    return _encoded(docs, path, text, piece_chars, spread_chars, keep_text, ("ids",))


def bpe_round_trip(
    docs: DataFrame,
    path: str,
    text: str = "text",
    piece_chars: int = PIECE_CHARS,
    spread_chars: int = SPREAD_CHARS,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, as ``bpe_decode`` of ``bpe_encode`` has them.

    A text is decoded by the worker that has encoded it, so that a task has one
    worker instead of two and no ids go back to one.
    """
    return _encoded(docs, path, text, piece_chars, spread_chars, keep_text, ("ids", "decoded"))


def _encoded(docs: DataFrame, path: str, text: str, piece_chars: int, spread_chars: int, keep_text: bool, results: tuple[str, ...]) -> DataFrame:
    # a text is sent once, outside of its row, which has a field even if there is nothing else
    others = [c for c in docs.columns if c != text and c not in results]
    row = F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(True)])
    rows = docs.select(row.alias("__row"), F.col(f"`{text}`").alias("__text"))
    size = F.length(F.coalesce("__text", F.lit("")))
    kept = rows.schema if keep_text else rows.select("__row").schema
    schema = StructType([*kept.fields, StructField("ids", ArrayType(IntegerType()))])
    if "decoded" in results:
        schema = schema.add("decoded", "string")
    small = rows.where(size <= spread_chars).mapInArrow(released(_encode_rows(path, piece_chars, schema.names)), schema)
    spread = _encode_spread(rows.where(size > spread_chars), path, piece_chars).select(*kept.names, "ids")
    if "decoded" in results:
        spread = bpe_decode(spread, path)
    columns = {c: F.col("__row")[c].alias(c) for c in others}
    if keep_text and text not in results:
        columns[text] = F.col("__text").alias(text)
    return small.unionByName(spread).select(*[columns[c] for c in docs.columns if c in columns], *results)


def _lists(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _encode_rows(path: str, piece_chars: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                ids = _lists(encode_texts(path, [x or "" for x in batch["__text"].to_pylist()], piece_chars))
                made = {"ids": ids, "decoded": decode_lists(path, ids) if "decoded" in names else None}
                yield pa.RecordBatch.from_arrays([made[n] if n in made else batch[n] for n in names], names)

    return run


UNITS = "starts array<int>, ends array<int>, tokens array<binary>, firsts array<boolean>"


def _encode_spread(rows: DataFrame, path: str, piece_chars: int) -> DataFrame:
    """``rows`` with ids: pieces are rows of their own, dealt by a digest of their text and their place.

    The digest is all that a piece knows of its row, so a task that runs again
    gives the same pieces, and copies of a text share them.
    """
    keyed = rows.withColumn("__key", F.sha2("__text", 256))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, whole in zip(batch["__key"].to_pylist(), batch["__text"].to_pylist()):
                spans = cuts(len(whole), piece_chars)
                yield pa.RecordBatch.from_pydict(
                    {"key": [key] * len(spans), "at": [a for a, _ in spans], "piece": [whole[a:b] for a, b in spans]},
                    pa.schema([("key", pa.string()), ("at", pa.int32()), ("piece", pa.string())]),
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode_piece(path, x, a) for x, a in zip(batch["piece"].to_pylist(), batch["at"].to_pylist())]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.bool_())
            columns = [pa.array([[t[k] for t in ts] for ts in found], pa.list_(kind)) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "starts", "ends", "tokens", "firsts"])

    leaves = (
        keyed.select("__key", "__text")
        .mapInArrow(pieces, "key string, at int, piece string")
        .dropDuplicates(["key", "at"])
        .mapInArrow(encode, f"key string, at int, piece string, {UNITS}")
    )

    def together(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        columns = (group[c].to_pylist() for c in ("at", "starts", "ends", "tokens", "firsts"))
        found = {at: list(zip(*lists)) for at, *lists in zip(*columns)}
        ids = _lists([fold(path, "".join(group["piece"].to_pylist()), found, piece_chars)])
        return pa.table([group["key"][:1].combine_chunks(), ids], ["key", "ids"])

    encoded = leaves.groupBy("key").applyInArrow(together, "key string, ids array<int>")
    return keyed.join(encoded, F.col("__key") == F.col("key"))


@cache
def _pieces(path: str) -> pa.Array | None:
    """All tokens by id, where decoding is no more than joining them."""
    t = tokenizer(path)
    found = [t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))]
    return None if t.decoder is not None or None in found else pa.array(found, pa.large_string())


def decode_lists(path: str, lists: pa.Array) -> pa.Array:
    """The text of each list of ids."""
    pieces, values = _pieces(path), lists.flatten()
    bounds = pc.min_max(values)
    if pieces is None or lists.null_count or values.null_count or (len(values) and not 0 <= bounds["min"].as_py() <= bounds["max"].as_py() < len(pieces)):
        return pa.array(tokenizer(path).decode_batch([x or [] for x in lists.to_pylist()], skip_special_tokens=False), pa.string())
    ends = pc.subtract(lists.offsets, lists.offsets[0])
    return pc.binary_join(pa.ListArray.from_arrays(ends, pieces.take(values)), pa.scalar(" ", pieces.type)).cast(pa.string())


def bpe_decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of the ids, special tokens included.

    Null ids decode to the empty string.
    """
    rows = tokens.select(struct_of(tokens, "decoded").alias("__row"), F.col(f"`{ids}`").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                yield pa.RecordBatch.from_arrays([batch["__row"], decode_lists(path, batch["__ids"])], ["__row", "decoded"])

    found = rows.mapInArrow(released(run), rows.select("__row").schema.add("decoded", "string"))
    return found.select(*fields(tokens, "__row", "decoded"), "decoded")
