"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.steps import discard, materialize, settings, shared_dir, steps  # noqa: F401 - used from here

#: White space that separates words everywhere in this subpackage.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Rows whose doc_id is null come after all others.
LAST_ID = (1 << 63) - 1
#: Bytes that cross to a Python worker at once, in ``small_batches``.
CROSSING, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def small_batches(spark: SparkSession):
    """Steps written inside hand texts and sets to Python in batches of some two megabytes, however long these are.

    An executor and its workers hold a batch several times, as buffers grow by
    doubling, and the executor's process keeps parts of large buffers for good.
    """
    return settings(spark, **{CROSSING: str(SMALL)})


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, for ``mapInArrow``; what Arrow keeps of a task's memory goes back to the system when it ends.

    Workers wait for the next task, of whatever step, with all that they have.
    """

    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return ending


def struct_of(df: DataFrame, *without: str) -> Column:
    """All columns of ``df`` but some as one struct, so that names of steps can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without])


def fields(df: DataFrame, row: str = "__row", *without: str) -> list[Column]:
    """The columns of ``df`` back from the struct of ``struct_of``."""
    return [F.col(row)[c].alias(c) for c in df.columns if c not in without]


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sums over all rows that come before in ``order``, which no two rows share.

    Rows are dealt by ranges and written; a task sorts one range, and of each
    range only its sums, one row, are added up in one place.
    """
    dealt = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    placed = materialize(dealt.withColumns({f"__add_{n}": c for n, c in sums.items()}), "ranges")
    totals = placed.groupBy("__range").agg(*[F.sum(f"__add_{n}").alias(f"__all_{n}") for n in sums])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as ranges, so as shuffle partitions
    totals = totals.select("__range", *[F.sum(f"__all_{n}").over(before).alias(f"__before_{n}") for n in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    value = {n: F.coalesce(f"__before_{n}", F.lit(0)) + F.coalesce(F.sum(f"__add_{n}").over(inside), F.lit(0)) for n in sums}
    out = placed.join(F.broadcast(totals), "__range").withColumns(value)
    return out.drop("__range", *[f"__add_{n}" for n in sums], *[f"__before_{n}" for n in sums])


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
