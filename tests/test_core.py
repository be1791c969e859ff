import os

import pytest
from pyspark.sql import functions as F

from replayframe import hand_queries, queries  # noqa: F401 - the former adds to the latter
from replayframe.functions import buckets, hashing, legality, scoring, text
from replayframe.operators import sequences, splits, stats

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    "value,expected",
    [(0, "ZERO"), (0.5, "0.25_TO_0.5"), (1.5, "1_TO_1.5"), (2.5, "2_TO_3"), (50, "20_TO_50"), (50.01, "50_TO_75"), (75, "50_TO_75"), (75.01, "75_TO_100"), (100, "75_TO_100"), (100.01, "100_TO_150"), (150, "100_TO_150"), (150.01, "GT_150")],
)
def test_bucket_edges(spark, value, expected):
    assert one(spark, buckets.range_bucket(F.col("v"), F.lit(1.0)), v=float(value)) == expected


def test_interval_distance(spark):
    d = lambda x: one(spark, buckets.interval_distance(F.lit(1.0), F.lit(2.0), F.col("t")), t=x)
    assert (d(1.0), d(1.5), d(2.0), d(3.0), d(0.5)) == (0, 0, 0, 1, 0.5)


def test_legality(spark):
    state = dict(to_call=10, current_bet=20, stack=90, reopened=True)
    allowed = lambda **k: one(spark, legality.legal_actions(*[F.col(c) for c in state]), **state | k)
    assert allowed() == ["FOLD", "CALL", "RAISE"]
    assert allowed(reopened=False) == ["FOLD", "CALL"]
    assert allowed(to_call=0, current_bet=0) == ["CHECK", "BET"]
    assert allowed(stack=0) == []

    def why(action, size, **k):
        cols = ["action", "size", "to_call", "current_bet", "stack", "min_bet", "min_raise", "reopened"]
        return one(spark, legality.check_action(*[F.col(c) for c in cols]), **state | dict(action=action, size=size, min_bet=10, min_raise=10) | k)

    assert why("RAISE", 20) is None and why("RAISE", 19) == "below the minimum"
    assert why("RAISE", 15, stack=15) is None
    assert why("BET", 10, to_call=0, current_bet=0) is None and why("BET", 9, to_call=0, current_bet=0) == "below the minimum"
    assert why("FOLD", 0, to_call=0, current_bet=0) == "action not available"


def test_order_statistics(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 7), ("b", None)], "g string, x int")
    medians = {r["g"]: (r["median"], r["n"]) for r in stats.exact_median(df, ["g"], "x").collect()}
    assert medians == {"a": (2.5, 4), "b": (7.0, 1)}
    ranks = {r["g"]: r["p"] for r in stats.nearest_rank(df, ["g"], "x", {"p": 0.5}).collect()}
    assert ranks == {"a": 3, "b": 7}  # round-half-even(1.5) = 2, the third value


def test_closest_subset():
    assert splits.closest_subset([("a", 5), ("b", 3), ("c", 2)], 5) == {"a"}
    assert splits.closest_subset([("a", 4), ("b", 6)], 5) == {"a"}
    assert splits.closest_subset([("a", 4)], 0) == set()


def test_split_is_disjoint_and_stable(spark):
    df = spark.createDataFrame([(i, f"g{i % 7}") for i in range(70)], "i int, g string")
    found = splits.split_groups(df, "g", "s", 0.2, 0.1)
    assert splits.leakage(found, "g").count() == 0
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, splits.split_groups(df.repartition(3), "g", "s", 0.2, 0.1).collect()))


def test_stable_fraction(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"seed\0x").digest()[:8], "big") / 2**64
    assert one(spark, hashing.stable_fraction(F.col("v"), "seed"), v="x") == want


def test_shift_and_pad(spark):
    s = spark.range(1).select(sequences.shift(F.array(*map(F.lit, [10, 11, 12, 13])), F.array(*map(F.lit, [0, 1, 0, 1]))).alias("s")).first()["s"]
    assert (s["inputs"], s["targets"], s["mask"]) == ([10, 11, 12], [11, 12, 13], [1, 0, 1])
    assert one(spark, sequences.pad(F.array(F.lit(20), F.lit(21)), F.lit(3), 99), v=1) == [20, 21, 99]


def test_softmax_and_groups(spark):
    p = F.array(*map(F.lit, [2.0, 2.1] + [0.0] * 10 + [1.0]))
    found = spark.range(1).select(scoring.softmax(p).alias("p"), scoring.argmax(p).alias("a"), scoring.top_k(p, 2).alias("k")).first()
    assert abs(sum(found["p"]) - 1) < 1e-12 and found["a"] == 1 and found["k"] == [1, 0]


def test_text_fields(spark):
    assert one(spark, text.header_field(F.col("v"), "variant"), v="a = 1\nvariant = 'NT'\n") == "'NT'"
    assert one(spark, text.list_literal(F.col("v"), "double"), v="[1, 2.5]") == [1.0, 2.5]
    assert one(spark, text.list_literal(F.col("v"), "int"), v="[1, x]") is None
    assert one(spark, text.cards(F.col("v")), v="AsKd") == ["As", "Kd"] and one(spark, text.cards(F.col("v")), v="????") == ["??", "??"]
    assert one(spark, text.cards(F.col("v")), v="AsK") is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    rows = lambda found: sorted(repr(tuple(map(plain, r))) for r in found)
    want = rows(want.fetchall())
    assert rows(tuple(r) for r in got.select(*names).collect()) == want
    assert want or name in ("novelty_prefix",)  # no rows would prove nothing


def test_closest_subset_is_that_of_all_subsets():
    import random

    rnd = random.Random(2)
    for _ in range(60):
        groups = [(f"g{k}", rnd.randrange(0, 30)) for k in range(9)]
        target = rnd.randrange(0, 120)
        # bits of a number are groups; of equal sums the smallest number was found first
        best = min(range(1 << 9), key=lambda m: (abs(sum(n for k, (_, n) in enumerate(groups) if m >> k & 1) - target), sum(n for k, (_, n) in enumerate(groups) if m >> k & 1), m))
        want = {g for k, (g, _) in enumerate(groups) if best >> k & 1}
        assert splits.closest_subset(groups, target) == (want if target else set())


def test_closest_subset_of_many_groups(monkeypatch):
    groups = [(k, 1 + k % 97) for k in range(100_000)]
    total = sum(n for _, n in groups)
    chosen = splits.closest_subset(groups, total // 20)
    assert sum(1 + k % 97 for k in chosen) == total // 20
    monkeypatch.setattr(splits, "MOST_SUMS", 1000)  # in units, off by half a unit for each
    some = splits.closest_subset([(k, 1000 + k) for k in range(40)], 8000)
    assert abs(sum(1000 + k for k in some) - 8000) <= 8 * len(some)


def test_groups_without_a_name(spark):
    rows = [(k, None if k % 10 < 4 else f"g{k % 10}") for k in range(100)]
    df = spark.createDataFrame(rows, "k int, g string")
    for seed in ("a", "b", "c", "d"):
        found = splits.split_groups(df, "g", seed, 0.4, 0.1)
        assert found.count() == 100 and found.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    # 0.4 of the rows are those without a group, if nothing else comes as close first
    assert splits.split_groups(spark.createDataFrame(rows[:4], df.schema), "g", "s", 0.9, 0.0).select("split").distinct().collect()[0][0] == "val"
    numbers = spark.createDataFrame([(k, k % 5, "old") for k in range(50)], "k int, g int, split string")
    assert {r["split"] for r in splits.split_groups(numbers, "g", "s", 0.2, 0.2).collect()} == {"train", "val", "test"}
