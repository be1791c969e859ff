"""Columns of the user that have the names of results or of steps come back as they were."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import replayframe
from replayframe.operators import batches, ranges, selection, sequences, splits, stats
from replayframe.operators.names import own_prefix
from replayframe.operators.once import once

HERE = Path(replayframe.__file__).parent
SOURCES = "".join(p.read_text() for d in ("operators", "sources", "streaming") for p in (HERE / d).glob("*.py"))
STEPS = {"range", "add_total", "all_total", "before_total", "key_g", "n", "upto", "island", "at", "hash", "there", "part", "rank", "pool", "batch", "size", "row", "rows", "content", "error", "group", "split", "made"}
NAMES = sorted({f"__{n}" for n in STEPS} | set(re.findall(r"\"(__[a-z_]+)\"", SOURCES))) + ["___at", "order", "value"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(k, f"g{k % 3}" if k % 7 else None, k % 4 == 0) for k in range(40)], "k int, g string, flag boolean")
    return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in NAMES])


def same(found, n):
    assert [tuple(r) for r in found.select(*NAMES).distinct().collect()] == [tuple(f"mine {x}" for x in NAMES)]
    assert found.count() == n


def test_operators_that_keep_rows(spark, rows):
    assert own_prefix(rows) == "____"
    for parts in (1, 3):
        same(ranges.range_sums(rows, ["g"], ["k"], {"total": F.col("k")}, parts), 40)
    same(sequences.running_offset(rows, "g", "k", "k"), 40)
    same(sequences.rolling(rows, "g", ["k"], "k", 3), 40)
    same(sequences.prefix_all(rows, "g", ["k"], "flag"), 40)
    same(sequences.keep_first(rows, ["g"], ["k"]), 4)
    same(sequences.exact_matches(rows.withColumn("known", F.lit("old")), rows.where("k < 5"), "k"), 40)
    same(splits.split_groups(rows, "g", "s"), 40)
    same(batches.length_batches(rows, "k", "k", 4, 8, "s", drop_last=True), 40)
    same(once(rows, {"twice": F.col("k") * 2}), 40)
    same(selection.with_content(rows.withColumnRenamed("g", "member"), spark.createDataFrame([("g1", "x", None)], "member string, content string, error string")), 40)


def test_operators_that_gather(rows):
    assert stats.exact_median(rows, ["g"], "k").count() == 4
    assert stats.nearest_rank(rows, ["g"], "k", {"p": 0.5}, 3).count() == 4
    assert sequences.streaks(rows, "g", ["k"], "flag").count() == 8
    assert {r["length"] for r in sequences.build(rows, "g", ["k"], F.col("k")).collect()} <= {10, 11, 12, 6}
    assert once(rows, {"k": F.col("k") + 1}).agg(F.sum("k")).first()[0] == sum(range(40)) + 40

