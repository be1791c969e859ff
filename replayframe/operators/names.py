"""Names for columns that operators add on the way, which no column of the user has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def own_prefix(*frames: DataFrame) -> str:
    """Underscores that begin no column of the frames; names under it are free, and stay so in any case."""
    prefix, taken = "__", [c for df in frames for c in df.columns]
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix
