"""Metrics as sums that can be added up: over batches, runs or clusters, in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is counted of outcomes, by name; rates are quotients of these and nothing else.
COUNTED = ("token_correct", "token_in_top", "action_correct", "action_in_top", "truth_aggressive", "sizing_error", "aggressive_correct")
ADDED = ("ratio_error", "interval_distance", "loss")
SUMS = ("decisions", "illegal", "hit_sizing_error", *COUNTED, *ADDED)


def metric_sums(found: DataFrame, by: list[str]) -> DataFrame:
    """One row of sums for each group of outcomes."""
    each = {c: F.count_if(c) for c in COUNTED} | {c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)) for c in ADDED}
    each |= {"decisions": F.count("*"), "illegal": F.count_if(~F.col("legal")), "hit_sizing_error": F.count_if(F.col("sizing_error") & F.col("aggressive_correct"))}
    return found.groupBy(*by).agg(*[each[c].alias(c) for c in SUMS])


def merge(sums: DataFrame, by: list[str]) -> DataFrame:
    """The sums of groups that were summed apart."""
    return sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def rates(sums: DataFrame, keep: list[str]) -> DataFrame:
    """The metrics that sums stand for, with the columns to ``keep``; a rate of nothing is null."""
    share = lambda c, of: F.try_divide(F.col(c), F.col(of))
    made: dict[str, Column] = {
        "decisions": F.col("decisions"),
        "token_accuracy": share("token_correct", "decisions"),
        "token_top_accuracy": share("token_in_top", "decisions"),
        "action_accuracy": share("action_correct", "decisions"),
        "action_top_accuracy": share("action_in_top", "decisions"),
        "illegal": F.col("illegal"),
        "aggressive": F.col("truth_aggressive"),
        "sizing_error_rate": share("sizing_error", "truth_aggressive"),
        "aggressive_correct": F.col("aggressive_correct"),
        "sizing_error_rate_if_correct": share("hit_sizing_error", "aggressive_correct"),
        "ratio_error": share("ratio_error", "aggressive_correct"),
        "interval_distance": share("interval_distance", "aggressive_correct"),
        "loss": share("loss", "decisions"),
    }
    return sums.select(*keep, *[c.alias(n) for n, c in made.items()])


def write_batch(found: DataFrame, batch: int, path: str, run: str, by: list[str]) -> None:
    """The sums of one batch of a run as its own folder, which a batch that comes again replaces: for ``foreachBatch``."""
    metric_sums(found, by).coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch}")
