"""Append only rows whose key the table doesn't hold yet, as a stream that can stop and go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sequences import keep_first


#: Parts of a batch by the hash of its keys; a batch looks for known keys in those parts of the others that it touches.
BUCKETS = 64


def append_new(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Start a query that takes what ``stream`` has now and adds rows of new keys to the Parquet table ``target``.

    The first row of a key, by ``order``, is kept; rows with a null in a key
    are left out. Each batch overwrites its own partition ``batch`` and looks
    for known keys in the others, so a batch that is run again after a failure
    adds nothing twice. Batches are cut into ``bucket`` partitions by their
    keys, and of the table only keys in the buckets of the batch are read.
    """
    spark: SparkSession = stream.sparkSession
    schema = stream.withColumns({"batch": F.lit(0).cast("bigint"), "bucket": F.lit(0)}).schema
    spark.createDataFrame([], schema).drop("batch", "bucket").write.mode("append").parquet(f"{target}/batch=-1/bucket=0")

    def write(rows: DataFrame, batch: int) -> None:
        placed = rows.dropna(subset=keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        touched = [r[0] for r in placed.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        known = rows.sparkSession.read.schema(schema).parquet(target).where((F.col("batch") != batch) & F.col("bucket").isin(touched)).select(*keys)
        fresh = keep_first(placed, keys, order).join(known, keys, "left_anti")
        fresh.select(*rows.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
