"""Progress of a job, counted while it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, error: str = "error", name: str = "progress") -> tuple[DataFrame, Observation]:
    """``df``, and what is known once it has been used: rows and rows in error."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(error).alias("errors")), seen
