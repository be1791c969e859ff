"""Encoded sequences by split: written with their offsets, read with checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.artifacts import offset_violations
from ..operators.selection import contract_gate
from ..operators.sequences import running_offset

SPLITS = ("train", "val", "test")


def write_splits(sequences: DataFrame, path: str, order: str = "position") -> None:
    """Write (ids, loss_mask, split, position) with ``start``, where each would begin if those of its split stood end to end.

    All splits are written by one job, whose committer publishes all or none.
    """
    sized = sequences.withColumn("length", F.size("ids").cast("long"))
    running_offset(sized, "split", order, "length", "start").write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str, block: int, permit_test: bool = False, order: str = "position") -> DataFrame:
    """One split; rows that don't fit together stop the job, and the test split is read on permission only."""
    if split not in SPLITS:
        raise ValueError(f"no such split: {split}")
    if split == "test" and not permit_test:
        raise PermissionError("the test split is sealed; pass permit_test=True")
    rows = spark.read.parquet(path).where(F.col("split") == split)
    if offset_violations(rows, "split", order, "start", "length").limit(1).count():
        raise ValueError(f"offsets of {split} don't follow one another")
    fits = (F.size("ids") == F.size("loss_mask")) & (F.size("ids") == F.col("length")) & (F.col("length") - 1 <= block)
    return contract_gate(rows, fits, f"a sequence of {split} doesn't fit its mask or its block")


def read_all(spark: SparkSession, path: str, block: int) -> DataFrame:
    """The union of the splits, for checks of the whole."""
    return read_split(spark, path, "train", block).unionByName(read_split(spark, path, "val", block)).unionByName(read_split(spark, path, "test", block, permit_test=True))
