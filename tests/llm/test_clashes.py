"""Columns of the user that have the names of results or of steps come back as they were."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import replayframe.llm
from replayframe.llm import bpe, html_extract, line_templates, mixing, near_copies, quality_rules, simhash, substrings, toxicity, url_filters

SOURCES = "".join(p.read_text() for p in Path(replayframe.llm.__file__).parent.glob("*.py"))
#: Every name that a step uses for a column of its own, and what steps call plain columns.
NAMES = sorted(set(re.findall(r"\b(__[a-z_0-9]*[a-z0-9])\b(?!__)", SOURCES)) - {"__file__", "__future__", "__init__", "__name__", "__slots__"})
NAMES += ["set", "fp", "key", "label", "first", "line", "leaf", "window", "span", "url", "rule", "short", "digest", "at", "piece", "ids_", "word", "same", "a", "b", "seats", "quota"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [f"the first words of text {k} and some others that make it long enough to be kept by all rules of the list of rules" for k in range(8)]
    texts += [texts[0], None, "", " \n ", "x" * 3000]
    rows = [(k if k else None, t, "en", f"s{k % 2}" if k != 3 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    rows.append(rows[1])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)] + [(1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def same(found, rows):
    assert len(NAMES) > 60
    got = found.select(*NAMES).distinct().collect()
    assert [tuple(r) for r in got] == [tuple(f"mine {n}" for n in NAMES)]
    assert found.count() == rows


def test_operators_that_keep_all_rows(spark, docs, labels):
    same(toxicity.learn(docs, labels).score(docs), 14)
    same(line_templates.without_recurring_lines(docs, spare_copies=True), 14)
    same(substrings.drop_repeats(docs), 14)
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    same(bpe.bpe_decode(bpe.bpe_encode(docs, path, spread_chars=100, piece_chars=64), path), 14)
    pages = docs.select("*", F.lit("http://a.example.com/x").alias("link"))
    rules = spark.createDataFrame([("block", "com", "/"), ("allow", "com", "/"), ("block", "example.com", "/x")], "verdict string, host string, path string")
    for few in (10, 0):
        judged = url_filters.filter_urls(pages.drop("rule"), rules, url="link", few=few).withColumnRenamed("rule", "found").withColumn("rule", F.lit("mine rule"))
        same(judged, 14)
        assert judged.select("found", "verdict").distinct().collect()[0][:] == ("example.com/x", "block")
    same(html_extract.extract_html(docs, "source"), 14)


def test_operators_that_drop_rows(spark, docs, labels):
    same(simhash.drop_near_duplicates(docs), simhash.drop_near_duplicates(docs.select("doc_id", "text")).count())
    same(near_copies.drop_near_copies(docs), near_copies.drop_near_copies(docs.select("doc_id", "text")).count())
    kept = quality_rules.keep_good(docs, labels)
    same(kept, kept.count())
    mixed = mixing.mixed_documents(docs)
    same(mixed, mixed.count())
    assert mixed.columns == docs.columns


def test_rules_without_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [r.verdict for r in url_filters.filter_urls(pages, none).collect()] == ["allow", "allow"]
    assert url_filters.filter_urls(pages.limit(0), none).count() == 0


def test_empty_tables(spark, labels):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert toxicity.learn(none, labels).score(none).count() == 0
    assert quality_rules.keep_good(none, labels).count() == 0
    assert near_copies.drop_near_copies(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    assert bpe.bpe_decode(bpe.bpe_encode(none, path), path).count() == 0


def test_another_tokenizer_is_not_split_at_words(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    t = bpe.tokenizer(path)
    assert bpe._habits(path) == (False, False)
    texts = ["Hello  World,\n\n  and more", "", "a" * 900, "Some words about Things. " * 80]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for kw in ({}, dict(piece_chars=200, spread_chars=500)):
        got = {r.k: r.ids for r in bpe.bpe_encode(df, path, **kw).collect()}
        assert got == {k: t.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts)}
