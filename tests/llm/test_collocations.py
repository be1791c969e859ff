import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from replayframe.llm import collocations as made
from replayframe.llm.collocations import collocations

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(docs, longest=3, best=2000, least=10):
    """Counts every run of words and looks at each pair of candidates."""
    counts, n = Counter(), Counter()
    for _, t, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(UPPER)):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                counts.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    candidates = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    covered = set()
    for g, longer in candidates.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                inside = (g[0], *g[i : i + k])
                if 100 * longer >= 50 * candidates.get(inside, 1 << 60):
                    covered.add(inside)
    scored = []
    for g, a in candidates.items():
        if g not in covered:
            cuts = []
            for k in range(1, len(g) - 1):
                left, right = counts[g[: k + 1]], counts[(g[0], *g[k + 1 :])]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            scored.append((g[0], -score, -a, " ".join(g[1:]).encode(), left, right))
    out, ranks = [], Counter()
    for lang, score, a, phrase, left, right in sorted(scored):
        ranks[lang] += 1
        if ranks[lang] <= best:
            out.append((lang, ranks[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(8)
    vocabulary = ["New", "york", "city", "the", "of", "é", "ÉT", "zz", "a\x00b", "\x00", "x\x1cy", "nbsp here", "𝒳", "ﬁ"] + [f"w{k}" for k in range(12)]
    texts = [None, "", " \t ", "...", "a a a a a a a a a a a a a", "b " * 9, "b\tb", "one, two. one two"]
    for _ in range(2500):
        ws = rnd.choices(vocabulary, weights=[6, 6, 6, 8, 8] + [2] * 21, k=rnd.randrange(1, 40))
        for i in range(len(ws) - 3):
            if rnd.random() < 0.1:
                ws[i : i + 3] = ["New", "York", "City"]
        texts.append("".join(w + rnd.choice((" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r", "\x0b", "\x0c", "; ")) for w in ws))
    found = [(k, t, rnd.choice(("en", "en", "fr", None, "und", ""))) for k, t in enumerate(texts)]
    return found + found[40:60] + [(7, "the of the of " * 3000, "fr")]


def test_against_plain_counts(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    want = plain(docs)
    assert len(want) > 100 and any(p[2].count(" ") > 1 for p in want)
    assert rows(collocations(df)) == want
    # many blocks of few words, many partitions, and columns with the names of steps
    names = ["block", "code", "word", "n", "codes", "id", "left", "right", "a", "phrase", "last", "starts", "ends", "rank", "score"]
    clashing = df.drop("doc_id").repartition(7).select("*", *[F.lit(f"mine {x}").alias(x) for x in names])
    assert rows(collocations(clashing, block_words=50)) == want


def test_longer_phrases_and_few_best(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert rows(collocations(df, longest=5, best=7, min_count=12)) == plain(docs, longest=5, best=7, least=12)


def test_slices_of_a_long_text(spark, docs, monkeypatch):
    monkeypatch.setattr(made, "SLICE", 10)
    text = docs[20][1].encode()
    assert [w for s in made.slices(text) for w in made.split_words(s)] == made.split_words(text.translate(made._PLAIN))
    assert list(made.slices(b"")) == []


def test_pairs_of_a_block():
    codes = np.array([0, 1, 0, 1, -1, 1, 2, 0, 1], np.int32)
    left, right, counts, places = made.pairs_of(codes, np.array([10, 11, -1, -1]))
    assert sorted(zip(left.tolist(), right.tolist(), counts.tolist())) == [(10, 11, 3), (11, 10, 1)]
    ab, ba = (next(i for i, x in enumerate(left) if x == y) for y in (10, 11))
    assert places.tolist() == [ab, ba, ab, -1, -1, -1, -1, ab]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations(none).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None), (2, "few words", "en")], none.schema)).count() == 0


def test_last_length_goes_back_to_no_block(spark, docs, monkeypatch):
    """Pairs of the last length are counted, one row each: no row for a pair of a block is numbered and written."""
    numbered, counted = [], []
    named, count = made._named, made._counted
    monkeypatch.setattr(made, "_named", lambda entries, of_words, least, name: numbered.append(name) or named(entries, of_words, least, name))
    monkeypatch.setattr(made, "_counted", lambda *args: counted.append(count(*args)) or counted[-1])
    monkeypatch.setattr(made, "discard", lambda *tables: None)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert rows(collocations(df, block_words=50)) == plain(docs)
    assert numbered == ["named", "named2"] and len(counted) == 1
    assert counted[0].columns == ["left", "right", "a"] and counted[0].count() == counted[0].select("left", "right").distinct().count() > 0
