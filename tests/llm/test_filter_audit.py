import random
import sys
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from replayframe.llm.filter_audit import audit

sys.path.insert(0, str(Path(__file__).parent))
from tests_llm_shared import words  # noqa: E402


def plain(docs, labels):
    """Walks every order over every document."""
    last = float("inf")
    least, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        least[t or ""] = min(least.get(t or "", last), last if i is None else i)
    for i, q, x in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if x == 1 else set()
    fails = []
    for i, t, lang in docs:
        t = t or ""
        ws = words(t)
        a, b = len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws)
        c = 100 * sum("A" <= x <= "Z" for x in t) > 10 * len(t)
        e = (last if i is None else i) > least[t]
        fails.append((lang or "", dict(zip("ABCDE", (a, b, c, any(x in "#$%&*|" for x in t), e))), i in good, i in toxic))
    out, shapley = {}, {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                only = sum(f[1][x] and sum(f[1].values()) == 1 for f in mine)
                out[part, order, step] = [len(left), len(gone), sum(f[1][x] for f in mine) - len(gone), only, sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in found}
    assert len(got) == len(found)
    return got


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t\n", "AB CD", "é" * 50]
    for k in range(60):
        t = " ".join(rnd.sample(vocabulary, rnd.choice((99, 100, 120))) + ["again"] * rnd.choice((0, 0, 60)))
        texts.append(t.upper() if k % 5 == 0 else t + rnd.choice(("", "", " #", " |")))
    texts.append("very " * 20_000)
    docs = [(k, t, rnd.choice(("en", "fr", "", None))) for k, t in enumerate(texts)]
    docs += [(100 + k, rnd.choice(texts), rnd.choice(("en", "fr"))) for k in range(40)]
    docs += [docs[9], docs[9], (None, texts[8], "en"), (None, "only here", None), (12, texts[20], "en")]
    labels = [(k, rnd.choice((0, 1, None)), rnd.choice((0, 1))) for k in range(0, 140, 2)] + [(4, 1, 0), (None, 1, 1)]
    return docs, labels


def test_against_a_walk_of_all_orders(spark, case):
    docs, labels = case
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain(docs, labels)
    assert len(want) == 3 * 600
    assert rows(audit(df, marks)) == want
    names = ["id", "part", "digest", "failed", "n", "quality", "toxic", "least", "first", "copy", "fails_a", "passed", "filter", "before", "step", "kept"]
    clashing = df.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])
    assert rows(audit(clashing, marks.select("*", *[F.lit("mine").alias(n) for n in names if n not in ("quality", "toxic")]))) == want


def test_copies_of_one_text_in_most_rows(spark):
    docs = [(k, "a text that most rows have" if k % 4 else f"text {k}", "en" if k % 3 else None) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows(audit(df, none)) == plain(docs, [])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
