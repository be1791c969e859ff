"""Rows as lines of JSON: strict reading, whole writing, and repair of what a stopped run left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import keep_first

BROKEN = "_corrupt_record"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of ``path``; blank lines are skipped, and a line that is no JSON of the schema stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """Replace ``path`` as a whole, with the keys of each line in order; a job that fails leaves no part of it as the result."""
    df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Add a record of metrics or the like to a log."""
    df.write.mode("append").json(path)


def repaired(spark: SparkSession, path: str, schema: str, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The rows of ``path`` without torn lines, rows without a key, and all but the first row of each key.

    The first row is that of the first file and, in it, of ``order`` or the
    first in the file.
    """
    rows = spark.read.schema(f"{schema}, {BROKEN} string").option("columnNameOfCorruptRecord", BROKEN).json(path)
    rows = rows.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()})
    good = rows.where(F.col(BROKEN).isNull()).drop(BROKEN).dropna(subset=keys)
    return keep_first(good, keys, [*(order or []), "__file", "__block", "__at"]).drop("__file", "__block", "__at")
