"""What each filter of a cascade removes, in every order, from one SQL CUBE.

A row of the cube over five failure flags and ``part`` whose selected flags are
all false counts the documents that pass all filters selected: the survivors of
that subset.  What an order of the filters keeps, removes and loses at a step
are differences between the survivors of two subsets, the filters before the
step and those with it, so all 120 orders need one pass over the texts.

Defined results: a null text is empty (it fails A alone, and E as any text); a
null part is the empty string; a null doc_id counts as larger than all others;
rows of the same id and text are copies of one another and none of them fails
E for the other; a document is good or toxic if any of its labels says so; an
empty table has no parts and so no rows.  Only named columns are read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, bind, discard, materialize, words

FILTERS = "ABCDE"
FLAGS = tuple(f"fails_{x.lower()}" for x in FILTERS)
COUNTS = ("n", "good", "toxic")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def text_failures(text: Column) -> Column:
    """A struct of the four failures that a text alone decides."""
    whole = F.coalesce(text, F.lit(""))
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def judged(ws: Column) -> Column:
        return F.struct(
            (F.size(ws) < LEAST_WORDS).alias(FLAGS[0]),
            (100 * F.size(F.array_distinct(ws)) < LEAST_DISTINCT * F.size(ws)).alias(FLAGS[1]),
            (100 * capitals > MOST_CAPITALS * F.length(whole)).alias(FLAGS[2]),
            whole.rlike("[#$%&*|]").alias(FLAGS[3]),
        )

    return bind(words(whole), judged)


def failure_counts(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, the five flags, n, good, toxic): the documents of each combination.

    A text and its copies share their flags, so copies meet as counts: first
    those of one id, then those of one digest, and no text is shuffled.
    """
    each = docs.select(
        F.coalesce(F.col(id).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"),
        text_failures(F.col(text)).alias("failed"),
    )
    each = each.groupBy("id", "part", "digest", "failed").agg(F.count("*").alias("n"))
    marks = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("id"))
    marks = marks.agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    marked = each.join(marks, "id", "left").fillna(0, ["quality", "toxic"])
    kinds = marked.groupBy("digest", "part", "failed", "quality", "toxic").agg(F.min("id").alias("least"), F.min_by("n", "id").alias("first"), F.sum("n").alias("n"))
    kinds = materialize(kinds, "kinds")
    # many parts may hold a text, but each of them in a row or four
    leaders = kinds.groupBy("digest").agg(F.min("least").alias("leader"))
    led = kinds.join(leaders, "digest").withColumn("first", F.when(F.col("least") == F.col("leader"), F.col("first")).otherwise(0))
    split = F.explode(F.array(F.struct(F.lit(False).alias("copy"), F.col("first").alias("m")), F.struct(F.lit(True).alias("copy"), (F.col("n") - F.col("first")).alias("m"))))
    rows = led.select("part", "failed", "quality", "toxic", split.alias("some")).where("some.m > 0")
    counts = [F.sum("some.m").alias("n"), F.sum(F.col("some.m") * F.col("quality")).alias("good"), F.sum(F.col("some.m") * F.col("toxic")).alias("toxic")]
    out = materialize(rows.groupBy("part", *[F.col("failed")[f].alias(f) for f in FLAGS[:4]], F.col("some.copy").alias(FLAGS[4])).agg(*counts), "failures")
    discard(kinds)
    return out


def survivors(failures: DataFrame) -> DataFrame:
    """(part, passed, n, good, toxic): ``passed`` has bit k for filter k; subsets that nothing passes are missing."""
    cube = failures.cube("part", *FLAGS).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping_id().alias("grouped"))
    # bits of grouping_id are set for columns that are summed over; the first column is the highest bit
    chosen = [F.expr(f"grouped & {1 << (len(FLAGS) - 1 - k)}") == 0 for k in range(len(FLAGS))]
    own_part = F.expr(f"grouped & {1 << len(FLAGS)}") == 0
    all_false = [~c | ~F.coalesce(F.col(f), F.lit(True)) for c, f in zip(chosen, FLAGS, strict=True)]
    passed = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(chosen)), F.lit(0))
    found = cube.where(own_part)
    for c in all_false:
        found = found.where(c)
    return found.select("part", passed.alias("passed"), *COUNTS)


def steps_of_orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, before, after) of all orders, five times 120 rows; sets are bits as in ``survivors``."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(FILTERS[x] for x in order), step, k, before, before | 1 << k))
            before |= 1 << k
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int, after int")


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step (from 1).

    kept, removed: documents after the step, and gone in it; redundant: those
    that fail its filter and were removed before; unique_fails: those that fail
    no other filter; good_lost, toxic_lost: of those removed, by their labels;
    shapley: its filter's removed, summed over all orders, at any step.
    """
    spark = docs.sparkSession
    failures = failure_counts(docs, labels, id, text, part)
    subsets = F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("passed")
    full = failures.select("part").distinct().select("part", subsets).join(survivors(failures), ["part", "passed"], "left").fillna(0, list(COUNTS))
    full = materialize(full, "survivors")
    of = {c: full.select("part", F.col("passed").alias(c), F.struct(*COUNTS).alias(f"of_{c}")) for c in ("before", "after")}
    # 80 pairs of subsets that differ by a filter
    last = len(FILTERS)
    pair = [(k, s, s | 1 << k, factorial(s.bit_count()) * factorial(last - 1 - s.bit_count())) for k in range(last) for s in range(1 << last) if not s >> k & 1]
    pairs = spark.createDataFrame(pair, "filter int, before int, after int, orders long")
    gone = F.broadcast(pairs).join(of["before"], "before").join(of["after"], ["part", "after"])
    removed = {c: F.col("of_before")[c] - F.col("of_after")[c] for c in COUNTS}
    gone = gone.select("part", "filter", "before", "after", "orders", F.col("of_after.n").alias("kept"), *[removed[c].alias(f"gone_{c}") for c in COUNTS])
    gone = materialize(gone, "pairs")
    every = (1 << last) - 1
    totals = gone.groupBy("part", "filter").agg(
        F.sum(F.col("orders") * F.col("gone_n")).alias("shapley"),
        F.sum(F.when(F.col("before") == 0, F.col("gone_n"))).alias("fails"),
        F.sum(F.when(F.col("after") == every, F.col("gone_n"))).alias("unique_fails"),
    )
    steps = F.broadcast(steps_of_orders(spark))
    out = steps.join(gone, ["filter", "before", "after"]).join(totals, ["part", "filter"])
    return out.select(
        "part",
        "filter_order",
        "step",
        "kept",
        F.col("gone_n").alias("removed"),
        (F.col("fails") - F.col("gone_n")).alias("redundant"),
        "unique_fails",
        F.col("gone_good").alias("good_lost"),
        F.col("gone_toxic").alias("toxic_lost"),
        "shapley",
    )
