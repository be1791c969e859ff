"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the ``WINDOW - SEED + 1`` shorter runs of
``SEED`` words that a window holds, the one with the least hash.  A window that
is found twice has its anchor twice, so documents are joined on anchors first.
An anchor found again is extended both ways, word by word, as far as windows
hold it: the span of these windows stands for all of them.  Equal spans match
as a whole, and count once however many documents have them; only distinct
spans are unfolded, to find windows that spans share in part.  Each window gets
the earliest document that has it, no pairs are made, and touching windows melt
into maximal repeats.

A copied passage costs a document one row for each anchor in it.  What a task
holds at once is one document.

Defined results: a null or empty text has no words; a text shorter than a
window loses none; a null doc_id comes after all others; rows that share a
doc_id don't precede one another, and equal rows get equal results; an empty
table gives an empty one; other columns pass through ``drop_repeats``, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, discard, fields, materialize, struct_of

#: Words of a window, and of the seeds in it.
WINDOW, SEED = 20, 10
RESULTS = ("n_words", "n_removed", "kept")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words, from the hashes of the words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out = out * _BASE + hashes[k : k + len(out)]
    return _mixed(out)


class Texts:
    """Words and window hashes of a batch of whole texts, laid end to end."""

    def __init__(self, texts: list[bytes | None], window: int, seed: int):
        from xxhash import xxh64_intdigest

        self.words = [(t or b"").split() for t in texts]  # bytes split at exactly the six ASCII white-space characters
        self.ends = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        n = int(self.ends[-1]) if len(self.ends) else 0
        hashes = np.fromiter(map(xxh64_intdigest, chain.from_iterable(self.words)), np.uint64, n)
        self.windows = _runs(hashes, window)
        #: The place in ``windows`` of each whole window of a text.
        self.places = np.concatenate([np.arange(a, max(a, b - window + 1)) for a, b in zip(self.starts, self.ends)] or [np.zeros(0, np.int64)]).astype(np.int64)
        seeds = _runs(hashes, seed)
        least = seeds[: len(self.windows)].copy()
        for k in range(1, window - seed + 1):
            np.minimum(least, seeds[k : k + len(least)], out=least)
        #: The anchor of each window: the least of its seeds.
        self.anchors = least.view(np.int64)

    def rows(self) -> np.ndarray:
        """For each place the number of its text."""
        return np.searchsorted(self.ends, self.places, side="right")


def _texts(batch: pa.RecordBatch, window: int, seed: int) -> Texts:
    return Texts(batch["__text"].cast(pa.binary()).to_pylist(), window, seed)


def _first_of_run(texts: Texts) -> np.ndarray:
    """Whether a place's anchor isn't that of the place before, in the same text."""
    p = texts.places
    new = np.ones(len(p), bool)
    new[1:] = (texts.anchors[p[1:]] != texts.anchors[p[:-1]]) | (np.diff(p) != 1)
    return new


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id), F.lit(LAST_ID)).cast("long").alias("__id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("__same"), F.col(text).alias("__text"))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(__id, __same, starts): the windows of each document that start earlier in another one.

    ``starts`` are word places; windows that repeat inside one document are
    left to the step that reads its text.
    """
    plain = _keyed(docs, id, text)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            t = _texts(batch, window, seed)
            first = _first_of_run(t)
            at, row = t.places[first], t.rows()[first]
            keys = np.unique(np.stack([row, t.anchors[at]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
            pick = pa.array(keys[0])
            yield pa.RecordBatch.from_arrays([batch["__id"].take(pick), batch["__same"].take(pick), pa.array(keys[1])], ["__id", "__same", "anchor"])

    anchors = materialize(plain.mapInArrow(seeds, "__id long, __same long, anchor long"), "anchors")
    # an anchor counts once for a document, and again only where another document has it
    spread = anchors.groupBy("anchor").agg(F.min("__id").alias("low"), F.max("__id").alias("high")).where("low < high").select("anchor")
    found = materialize(anchors.join(spread, "anchor", "left_semi").groupBy("__id", "__same").agg(F.collect_set("anchor").alias("anchors")), "found")
    discard(anchors)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in _chunks(batches):
            t = _texts(batch, window, seed)
            row, known = t.rows(), batch["anchors"].to_pylist()
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            opens = _first_of_run(t)
            pick, names, starts, spans = [], [], [], []
            for k in range(batch.num_rows):
                places, opened = t.places[bounds[k] : bounds[k + 1]], opens[bounds[k] : bounds[k + 1]]
                first = np.flatnonzero(opened)
                ends = np.append(first[1:], len(places))
                again = np.isin(t.anchors[places[first]], np.array(known[k], np.int64))
                seen = set()
                for a, b in zip(first[again].tolist(), ends[again].tolist()):
                    span = t.windows[places[a] : places[a] + b - a]
                    name = xxh64_intdigest(span.tobytes())
                    if name in seen:  # of spans that repeat inside the text the first will do
                        continue
                    seen.add(name)
                    pick.append(k)
                    names.append(name)
                    starts.append(int(places[a] - t.starts[k]))
                    spans.append(span.view(np.int64))
            at = pa.array(pick, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["__id"].take(at), batch["__same"].take(at), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(starts, pa.int32()), pa.array(spans, pa.list_(pa.int64()))],
                ["__id", "__same", "span", "start", "windows"],
            )

    spans = materialize(plain.join(found, ["__id", "__same"]).mapInArrow(extend, "__id long, __same long, span long, start int, windows array<long>"), "spans")
    discard(found)
    each = spans.groupBy("span").agg(F.min("__id").alias("low"), F.max("__id").alias("high"), F.first("windows").alias("windows"))
    each = materialize(each, "distinct")
    unfolded = each.select("span", "low", "high", F.posexplode("windows").alias("place", "window"))
    shared = unfolded.groupBy("window").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.count("*").alias("spans")).where("first < last")
    # a window of one span only has the span's documents; those of more are looked up
    several = materialize(shared.where("spans > 1").select("window", "first"), "shared")
    inside = unfolded.join(several, "window").groupBy("span").agg(F.collect_list(F.struct("place", "first")).alias("several"))
    size = F.size("windows")
    looked_up = F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.coalesce(F.try_element_at("by_place", j), F.col("low")))
    firsts = F.when(F.col("several").isNull(), F.array_repeat("low", size)).otherwise(looked_up)
    listed = each.join(inside, "span", "left").where((F.col("low") < F.col("high")) | F.col("several").isNotNull())
    listed = listed.withColumn("by_place", F.map_from_entries("several"))
    listed = materialize(listed.select("span", firsts.alias("firsts")), "listed")
    met = spans.drop("windows").join(listed, "span")
    later = F.filter(F.transform("firsts", lambda f, j: F.when(f < F.col("__id"), F.col("start") + j)), lambda x: x.isNotNull())
    later = met.select("__id", "__same", later.alias("starts")).where(F.size("starts") > 0)
    out = materialize(later.groupBy("__id", "__same").agg(F.flatten(F.collect_list("starts")).alias("starts")), "repeats")
    discard(spans, each, several, listed)
    return out


def remove(words: list[bytes], starts: list[int] | None, windows: np.ndarray, window: int) -> np.ndarray:
    """Which words stay, given the windows that start earlier elsewhere and the hashes of all."""
    later = np.ones(len(windows), bool)
    _, first = np.unique(windows, return_index=True)
    later[first] = False
    if starts:
        # a start stands for all equal windows of the text, whose later ones are marked already
        later[np.array(starts, np.int64)] = True
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(later)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step[:-1]) == 0


def drop_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space).

    Columns of theirs with these names are replaced.
    """
    found = repeats(docs, id, text, window, seed)
    keyed = docs.select(struct_of(docs, *RESULTS).alias("__row"), F.col(text).alias("__text"), F.coalesce(F.col(id), F.lit(LAST_ID)).cast("long").alias("__id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("__same"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            t = _texts(batch, window, seed)
            n, removed, kept = [], [], []
            for words, a, b, starts in zip(t.words, t.starts, t.ends, batch["starts"].to_pylist()):
                stay = remove(words, starts, t.windows[a : max(a, b - window + 1)], window)
                n.append(len(words))
                removed.append(len(words) - int(stay.sum()))
                kept.append(b" ".join([w for w, s in zip(words, stay.tolist()) if s]))
            yield pa.RecordBatch.from_arrays(
                [batch["__row"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["__row", "n_words", "n_removed", "kept"]
            )

    joined = keyed.join(found, ["__id", "__same"], "left").select("__row", "__text", "starts")
    schema = joined.select("__row").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return joined.mapInArrow(cut, schema).select(*fields(docs, "__row", *RESULTS), *RESULTS)
