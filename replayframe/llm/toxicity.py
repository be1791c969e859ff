"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text are densities of a lexicon, the share of lexicon hits
near a second-person word, and rates of capitals, punctuation and obfuscated
words.  The lexicon (words and word beginnings) is learned from one half of the
labelled rows, the trees and the calibration from the other, so that densities
mean the same in training and in use.  Labelled rows come from a sample of at
most ``MOST_LABELS`` rows; all rows are scored.

Defined results: a null or empty text has the features zero and gets the score
that the model gives these; rows without a label, or with a null one, aren't
learned from, and an id with two labels counts as toxic; without any toxic or
any clean label every score is the share of toxic labels (0 without labels);
texts of one calibration step tie; repeated rows are scored each for itself; an
empty table gives an empty one; other columns pass through, whatever their
names, and a column named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import bind, fields, struct_of

#: Labelled rows that are learned from, at most; of more, those with the smallest hash.
MOST_LABELS = 20_000
#: Terms of the lexicon, and the least number of toxic rows that have one.
LEXICON, LEAST_ROWS = 400, 3
PREFIXES = (4, 5, 6, 7)
#: Terms at least so many times likelier in toxic rows are strong.
STRONG = log(12.0)
#: Words that address the reader, in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself tu te toi ton ta vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus vosotros".split())
#: Words between a lexicon hit and a second-person word that count as near.
NEAR = 5
THRESHOLD = 0.3

FEATURES = ("strong", "weak", "weight", "hits", "distinct", "share_of_words", "near_you", "you", "capitals", "all_capitals", "exclaim", "question", "punctuation", "symbols", "obfuscated", "digits", "log_words", "word_length", "distinct_words")

_WORD = re.compile(r"\w+")
_OBFUSCATED = re.compile(r"\b(?=\w*[^\W\d_])(?:\w*[a-zA-Z][0-9@$!*#]+[a-zA-Z]\w*)")


def terms(word: str) -> list[str]:
    """What a lower-case word can match: itself (``=``) and its beginnings."""
    return [f"={word}", *[word[:k] for k in PREFIXES if len(word) >= k]]


class Lexicon:
    """Weights of words and beginnings; a word's weight is that of its best term."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > 500_000:
                self.known.clear()
            w = self.known[word] = max((self.weights.get(t, 0.0) for t in terms(word)), default=0.0)
        return w


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    words = _WORD.findall(text.lower())
    n, chars = max(1, len(words)), len(text)
    weight = lexicon.weight
    found = [(k, x, w) for k, w in enumerate(words) if (x := weight(w)) > 0]
    you = [k for k, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if you and found:
        places = np.array(you)
        at = np.searchsorted(places, [k for k, _, _ in found])
        hits = np.array([k for k, _, _ in found])
        left = hits - places[np.maximum(at - 1, 0)]
        right = places[np.minimum(at, len(places) - 1)] - hits
        near = int(((np.abs(left) <= NEAR) | (np.abs(right) <= NEAR)).sum())
    strong = sum(x >= STRONG for _, x, _ in found)
    letters = sum(map(len, words)) or 1
    upper = sum(map(str.isupper, text))
    distinct = set(words)
    return [
        100 * strong / n,
        100 * (len(found) - strong) / n,
        100 * sum(x for _, x, _ in found) / n,
        min(50.0, float(strong)),
        float(len({w for _, x, w in found if x >= STRONG})),
        len(found) / len(distinct) if distinct else 0.0,
        near / max(1, len(found)),
        100 * len(you) / n,
        upper / chars,
        float(upper > letters / 2),
        text.count("!") / n,
        text.count("?") / n,
        sum(text.count(c) for c in ".,;:") / n,
        sum(text.count(c) for c in "#*$%&|<>") / n,
        100 * len(_OBFUSCATED.findall(text)) / n,
        sum(text.count(c) for c in "0123456789") / chars,
        log(1 + len(words)),
        letters / n,
        len(distinct) / n,
    ]


def add_features(docs: DataFrame, text: str, weights: dict[str, float]) -> DataFrame:
    """``docs`` with ``__features``, the features of the whole ``text`` as doubles."""
    schema = StructType([*docs.schema.fields, StructField("__features", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                values = np.array([features(t, lexicon) for t in batch[text].to_pylist()], float).reshape(-1)
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(values))], schema.names)

    return docs.mapInArrow(run, schema)


def learn_lexicon(rows: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Terms of ``rows`` (text, toxic) with their log odds; a bounded table comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                found = sorted({x for w in set(_WORD.findall((t or "").lower())) for x in terms(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], ["term", "toxic"])

    sizes = rows.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    p0, n0 = sizes["p"] or 0, sizes["n"] - (sizes["p"] or 0)
    if not p0 or not n0:
        return {}
    counts = rows.mapInArrow(run, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (p0 + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (n0 + 1))
    top = counts.where(F.col("p") >= LEAST_ROWS).withColumn("odds", odds).where("odds > 1.2").orderBy(F.desc(F.col("odds") * F.sqrt("p")), "term").limit(most)
    return {r["term"]: r["odds"] for r in top.collect()}


class Model:
    """Lexicon, trees and calibration; ``score`` adds a column from 0 to 1."""

    def __init__(self, weights, trees, calibration, constant: float):
        self.weights, self.trees, self.calibration, self.constant = weights, trees, calibration, constant

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        kept = docs.select(struct_of(docs, name).alias("__row"), F.col(f"`{text}`").alias("__text"))
        if self.trees is None:
            return kept.select(*fields(docs, "__row", name), F.lit(self.constant).alias(name))
        raw = _raw(self.trees, add_features(kept, "__text", self.weights).drop("__text"))
        return raw.select(*fields(docs, "__row", name), _between(F.col("__raw"), *self.calibration).alias(name))


def _raw(trees, rows: DataFrame) -> DataFrame:
    """``rows`` with ``__raw``, the trees' probability for their ``__features``."""
    found = trees.transform(rows.withColumn("__vector", array_to_vector("__features")))
    return found.withColumn("__raw", vector_to_array("__probability")[1]).drop("__vector", "__probability", "__margin", "__predicted")


def _between(raw: Column, xs: list[float], ys: list[float]) -> Column:
    """The isotonic line through the points, by a binary search for the last one at or before ``raw``."""
    steps = [1 << k for k in reversed(range(len(xs).bit_length()))]
    points, values = F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))

    def further(low: Column, step: Column) -> Column:
        at = low + step  # how many points are known to lie at or before it
        return F.when((at <= len(xs)) & (F.get(points, at - 1) <= raw), at).otherwise(low)

    def line(before: Column) -> Column:
        x, y = F.get(points, before - 1), F.get(values, before - 1)
        wide = F.get(points, before) - x
        rise = F.when(wide > 0, (F.get(values, before) - y) * (raw - x) / wide).otherwise(0.0)
        return F.when(before == 0, ys[0]).when(before == len(xs), ys[-1]).otherwise(y + rise)

    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), bind(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further), line)))


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_LABELS) -> Model:
    """The model for ``label`` from labelled rows of ``docs``."""
    by_hash = F.xxhash64(F.lit("sample"), F.col("__id"))
    known = labels.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("toxic")).where("toxic is not null and __id is not null")
    some = known.groupBy("__id").agg(F.max("toxic").alias("toxic")).orderBy(by_hash, "__id").limit(most)
    # the labels of at most MOST_LABELS rows, ids and a number, are small enough to broadcast
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(some), "__id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("__id")), F.lit(20)))
    rows = rows.persist()
    dense = None
    try:
        weights = learn_lexicon(rows.where("part < 10"))
        dense = add_features(rows.where("part >= 10"), "text", weights).drop("text").persist()
        sizes = dense.groupBy((F.col("part") < 16).alias("grow")).agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).collect()
        by = {r["grow"]: (r["p"], r["n"] - r["p"]) for r in sizes}
        if not all(min(by.get(k, (0, 0))) for k in (True, False)):
            share = rows.agg(F.avg("toxic")).first()[0]
            return Model(weights, None, None, float(share or 0.0))
        grown = dense.where("part < 16").select("toxic", array_to_vector("__features").alias("__vector")).coalesce(2)
        trees = GBTClassifier(labelCol="toxic", featuresCol="__vector", predictionCol="__predicted", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, minInstancesPerNode=3, seed=7)
        trees = trees.setProbabilityCol("__probability").setRawPredictionCol("__margin").fit(grown)
        judged = _raw(trees, dense.where("part >= 16")).select(F.col("toxic").cast("double").alias("label"), F.col("__raw").alias("raw")).coalesce(1)
        line = IsotonicRegression(labelCol="label", featuresCol="raw", predictionCol="p").fit(judged)
        return Model(weights, trees, (list(map(float, line.boundaries)), list(map(float, line.predictions))), 0.0)
    finally:
        for cached in (dense, rows):
            if cached is not None:
                cached.unpersist()
