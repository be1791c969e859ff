"""Portable hashes of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_fraction(value: Column, seed: str) -> Column:
    """The first 64 bits of SHA-256(seed, NUL, value) as a fraction of one."""
    digest = F.sha2(F.concat(F.lit(seed + "\0"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))
