import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from replayframe.operators import stretches


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    order = rnd.sample(range(-500, 5000), 900)
    return [(k, rnd.choice(("a", "b", None)), rnd.choice((True, True, True, False, None)), rnd.choice((1, 2, 5, None))) for k in order]


SCHEMA = "at int, g string, flag boolean, value int"


@pytest.mark.parametrize("ranges", [1, 8])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_against_loops(spark, rows, ranges, by):
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("mine").alias("__place"), F.lit("mine").alias("__cut"))
    groups = {}
    for r in sorted(rows):
        groups.setdefault(r[1] if by else "", []).append(r)
    longest, rolled, fine = {}, {}, {}
    for g, own in groups.items():
        for flag, run in groupby(own, key=lambda r: r[2]):
            longest[g, flag] = max(longest.get((g, flag), 0), len(list(run)))
        for i, r in enumerate(own):
            some = [x[3] for x in own[max(0, i - 6) : i + 1] if x[3] is not None]
            rolled[r[0]] = (sum(some) if some else None) if i >= min(7, len(own)) - 1 else None
            fine[r[0]] = all(x[2] for x in own[: i + 1])
    name = lambda r: r["g"] if by else ""
    assert {(name(r), r["flag"]): r["longest"] for r in stretches.streaks(df, by, ["at"], "flag", ranges).collect()} == longest
    for stretch in (10, 1 << 16):
        got = stretches.rolling(df, by, ["at"], "value", 7, ranges=ranges, stretch=stretch)
        assert got.columns == [*df.columns, "rolled"]
        assert {r["at"]: r["rolled"] for r in got.collect()} == rolled
    assert {r["at"]: r["all_so_far"] for r in stretches.prefix_all(df, by, ["at"], "flag", ranges=ranges).collect()} == fine


def test_one_group_goes_over_many_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.range(1_000_000).select(F.col("id").alias("at"), (F.col("id") % 1000 < 700).alias("flag"), F.lit(1).alias("value"))
        rolled = stretches.rolling(df, [], ["at"], "value", 50, ranges=32, stretch=1 << 14)
        tasks = rolled.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.min("rolled").alias("least"), F.max("rolled").alias("most")).collect()
        assert len(tasks) >= 8 and sum(r.n for r in tasks) == 1_000_000 and max(r.n for r in tasks) < 300_000
        assert {r.least for r in tasks} == {r.most for r in tasks} == {50}
        assert {r.flag: r.longest for r in stretches.streaks(df, [], ["at"], "flag", 32).collect()} == {True: 700, False: 300}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1, "a", True, 2), (2, "a", True, 3)], SCHEMA)
    assert [r.rolled for r in stretches.rolling(df, ["g"], ["at"], "value", 5).orderBy("at").collect()] == [None, 5]
    assert stretches.streaks(df.limit(0), [], ["at"], "flag").count() == 0
    assert stretches.rolling(df.limit(0), [], ["at"], "value", 5).count() == 0
    with pytest.raises(ValueError):
        stretches.rolling(df, [], ["at"], "value", 0)
