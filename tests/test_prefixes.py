import random

from pyspark.sql import functions as F

from replayframe.operators import prefixes


def test_against_loops(spark):
    rnd = random.Random(3)
    make = lambda n: [(k, [rnd.choice("ab") for _ in range(rnd.randrange(0, 9))]) for k in range(n)] + [(n, None)]
    asked, stored = make(60), [*make(200), (3, ["a", "b"]), (3, ["a", "b"])]
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size("items"), F.lit(1))), lambda k: (k % 2 == 0) & (k <= F.size("items")))
    schema = "id int, items array<string>"
    one, two = spark.createDataFrame(asked, schema), spark.createDataFrame(stored, schema)
    got = prefixes.prefix_counts(one.withColumn("__k", F.lit("mine")), two.withColumn("__one", F.lit(1)), ["id"], "items", ends)
    want = sorted((i, k, sum(y is not None and len(y) >= k and y[:k] == x[:k] for _, y in stored)) for i, x in asked if x is not None for k in range(2, len(x) + 1, 2))
    assert sorted(tuple(r) for r in got.collect()) == want and any(n == 0 for *_, n in want) and any(n > 1 for *_, n in want)
    assert prefixes.prefix_counts(one, two.limit(0), ["id"], "items", ends).agg(F.max("n")).first()[0] == 0


def test_blocks_and_nulls(spark):
    """Prefixes over several blocks; a null is an item of its own, and where other lengths lie doesn't matter."""
    rnd = random.Random(5)
    base = [rnd.choice(["a", "b", None]) for _ in range(200)]
    make = lambda cut: [*base[:cut], *[rnd.choice(["a", "b", None]) for _ in range(200 - cut)]]
    asked, stored = [(k, make(c)) for k, c in enumerate((0, 63, 64, 65, 130, 200))], [(k, make(rnd.randrange(201))) for k in range(80)] + [(90, [None, "a"]), (91, ["a", None]), (92, [None])]
    asked += [(7, ["a", None]), (8, [None, "a"])]
    ends = F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, (1, 2, 63, 64, 65, 128, 150, 200, 300)))).otherwise(F.array(*map(F.lit, (2, 1, 64, 128, 200, 200, 0, -3))))
    own = lambda i, n: {k for k in ((1, 2, 63, 64, 65, 128, 150, 200, 300) if i % 2 == 0 else (2, 1, 64, 128, 200)) if k <= n}
    schema = "id int, items array<string>"
    got = prefixes.prefix_counts(spark.createDataFrame(asked, schema), spark.createDataFrame(stored, schema), ["id"], "items", ends)
    want = sorted((i, k, sum(k in own(j, len(y)) and y[:k] == x[:k] for j, y in stored)) for i, x in asked for k in own(i, len(x)))
    assert sorted(tuple(r) for r in got.collect()) == want and any(n > 1 and k >= 128 for _, k, n in want)


def test_a_key_that_stands_twice(spark):
    """The sequence compared is one that has the hashes, not any of the same key."""
    schema, ends = "id int, items array<string>", F.array(F.lit(2))
    stored = spark.createDataFrame([(3, [x, "b"]) for x in "acdefgh"], schema)
    got = prefixes.prefix_counts(spark.createDataFrame([(k, [x, "b"]) for k, x in enumerate("acdefgh")], schema), stored, ["id"], "items", ends)
    assert [r.n for r in got.collect()] == [1] * 7


def test_a_common_prefix_is_counted_before_it_is_joined(spark, monkeypatch):
    written = []
    monkeypatch.setattr(prefixes, "materialize", lambda df, name: written.append(df) or df)
    df = spark.createDataFrame([(k, ["a", "b"]) for k in range(9)], "id int, items array<string>")
    got = prefixes.prefix_counts(df.where("id < 2"), df, ["id"], "items", F.array(F.lit(2)))
    assert [r.n for r in got.collect()] == [9, 9]
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in plan[plan.index("Join ") :]
