import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from replayframe.functions import decisions, scoring
from replayframe.operators import metrics, ranges, sequences, stats


def test_running_sums_by_ranges_match_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), k, rng.randrange(5)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, k int, v int")
    for n in (1, 7):
        got = {r.k: (r.before, r.rank) for r in ranges.range_sums(df, ["g"], ["x", "k"], {"before": F.col("v"), "rank": F.lit(1)}, n).collect()}
        for g, x, k, _ in rows:
            order = lambda r: (r[1] is not None, r[1] or 0, r[2])
            earlier = [r for r in rows if r[0] == g and order(r) < order((g, x, k))]
            assert got[k] == (sum(r[3] for r in earlier), len(earlier)), (n, k)
    assert ranges.range_sums(df.limit(0), ["g"], ["x"], {"n": F.lit(1)}).count() == 0


def test_ranks_by_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), Decimal(rng.randrange(1000)) / 100) for _ in range(301)] + [("c", Decimal("0.01")), ("c", Decimal("0.02"))]
    df = spark.createDataFrame(rows, "g string, v decimal(10,2)")
    got = {r.g: r.median for r in stats.exact_median(df, ["g"], "v", ranges=9).collect()}
    p = {r.g: r.p for r in stats.nearest_rank(df, ["g"], "v", {"p": 0.95}, ranges=9).collect()}
    for g in "abc":
        vs = sorted(v for x, v in rows if x == g)
        assert got[g] == (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2
        assert p[g] == vs[round((len(vs) - 1) * 0.95)]


def test_confusion_counts_all_labels(spark):
    n = 1500
    df = spark.range(n).select(F.col("id").cast("int").alias("t"), F.col("id").cast("int").alias("p"))
    found = metrics.confusion(df, "t", "p", df.select(F.col("t").alias("label")))
    assert found.agg(F.count("*"), F.sum("n")).first() == (n * n, n)
    with pytest.raises(ValueError, match="dense"):
        metrics.confusion(df, "t", "p", spark.range(metrics.MOST_LABELS + 1).withColumnRenamed("id", "label"))


def test_rolling_windows_of_short_groups(spark):
    df = spark.createDataFrame([("a", k, 1) for k in range(5)] + [("b", 0, 1), ("b", 1, 0)], "g string, k int, v int")
    found = sequences.rolling(df, "g", ["k"], "v", 3).where("rolled is not null").groupBy("g").agg(F.min("rolled"), F.count("*")).collect()
    assert sorted(map(tuple, found)) == [("a", 3, 3), ("b", 1, 1)]


def test_a_key_of_too_many_rows_stops(spark, monkeypatch):
    monkeypatch.setattr(sequences, "MOST_ITEMS", 3)
    df = spark.createDataFrame([("a", k) for k in range(4)], "g string, k int")
    with pytest.raises(Exception, match="more than 3 rows"):
        sequences.build(df, "g", ["k"], F.col("k")).collect()
    assert sequences.build(df.where("k < 3"), "g", ["k"], F.col("k")).first()["items"] == [0, 1, 2]


def test_tokens_mean_actions(spark):
    reps = {"RANGE_0.5_TO_0.75": Decimal("0.625")}
    row = spark.range(1).select(F.lit("RANGE_0.5_TO_0.75").alias("t"), *[F.lit(Decimal(v)).cast("decimal(20,4)").alias(k) for k, v in {"pot": 10, "owed": 0, "bet": 0, "stack": 90}.items()])
    said = decisions.interpret(F.col("t"), F.col("pot"), F.col("owed"), F.col("bet"), F.col("stack"), reps)
    found = row.select(said.alias("s")).first()["s"]
    assert (found["action"], float(found["amount"])) == ("BET", 6.25)
    with pytest.raises(Exception, match="no decision token"):
        row.select(decisions.action_group(F.lit("RANGE_ZERO"))).collect()
    p = F.array(*map(F.lit, [0.25, 0.25, 0.5]))
    drawn = [spark.range(1).select(scoring.sample(p, F.lit(u))).first()[0] for u in (0.0, 0.2499, 0.25, 0.49, 0.5, 0.9999)]
    assert drawn == [0, 0, 1, 1, 2, 2]
