"""Digests of files, and one digest of a set of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files of one set; a larger set is combined by parts.
MOST_FILES = 100_000


def digests(files: DataFrame) -> DataFrame:
    """(name, size, digest) of files (path, content), as ``spark.read.format("binaryFile")`` gives them."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"))


def combined(found: DataFrame) -> DataFrame:
    """One row (files, size, digest): the digest of the lines name, size and digest in the order of names.

    Only lines of some 100 bytes are gathered, of at most ``MOST_FILES`` files.
    """
    if found.limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files; combine them by folders")
    line = F.concat("name", F.lit("\0"), F.col("size").cast("string"), F.lit("\0"), "digest", F.lit("\n"))
    lines = F.sort_array(F.collect_list(F.struct("name", line.alias("line"))))
    return found.agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), ""), 256).alias("digest"))
