"""Batches of sequences of similar length, in an order that a seed and an epoch fix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_fraction
from .names import own_prefix


def length_batches(rows: DataFrame, key: str, length: str, batch: int, pool: int, seed: str, epoch: int = 0, drop_last: bool = False, pools: int = 1) -> DataFrame:
    """``rows`` with ``pool``, ``batch`` and ``batch_order``.

    Rows are ordered by a hash of seed, epoch and key, cut into pools, sorted
    by length in their pool and cut into batches; a hash orders the batches.
    The order by hash is made in ``pools`` parts of the hash's range, each of
    which ends with a pool of its own, so that no task holds all rows.
    """
    if batch <= 0 or pool < batch or pool % batch:
        raise ValueError("a pool is a multiple of a batch")
    hash_, part, rank, own, at, cut, size = (own_prefix(rows) + x for x in ("hash", "part", "rank", "pool", "at", "batch", "size"))
    hashed = rows.withColumn(hash_, stable_fraction(F.col(key), f"{seed}:{epoch}")).withColumn(part, F.floor(F.col(hash_) * pools).cast("int"))
    placed = hashed.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(hash_, key)) - 1)
    placed = placed.withColumn(own, F.floor(F.col(rank) / pool))
    inside = Window.partitionBy(part, own)
    placed = placed.withColumn(at, F.row_number().over(inside.orderBy(length, rank)) - 1).withColumn(cut, F.floor(F.col(at) / batch))
    name = F.concat_ws("-", part, own, cut)
    placed = placed.withColumns({"pool": F.concat_ws("-", part, own), "batch": name, "batch_order": stable_fraction(name, f"{seed}:{epoch}:batches")})
    if drop_last:
        placed = placed.withColumn(size, F.count("*").over(Window.partitionBy(part, own, cut))).where(F.col(size) == batch)
    return placed.drop(hash_, part, rank, own, at, cut, size)


def after_cursor(batched: DataFrame, cursor: float) -> DataFrame:
    """The rows of batches that come after the one of order ``cursor``: where a run goes on."""
    return batched.where(F.col("batch_order") > cursor)
