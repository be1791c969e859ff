"""Tables of steps: written once in a folder that driver and executors share, read as often as needed."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished step are not needed once its table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local master writes beside its warehouse;
    on a cluster nothing tells that a folder is shared, so that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"


#: Tables written inside the open ``steps`` blocks of this thread or task, innermost last.
_WRITTEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("written", default=())


@contextmanager
def steps() -> Iterator[None]:
    """Delete the tables of all steps inside when the block ends: what reads them must be written by then."""
    own: list[DataFrame] = []
    before = _WRITTEN.set((*_WRITTEN.get(), own))
    try:
        yield
    finally:
        _WRITTEN.reset(before)
        discard(*own)


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """``values`` are the session's settings inside, what was there before is afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def materialize(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with a table that outlives lost executors; the
    shuffle files of the step are freed when it has been written.  The table is
    deleted by ``discard``, at the end of the innermost ``steps`` block around
    (of the next one, if it is ``kept``), or else when the driver ends; what a
    killed driver leaves stands in a folder of its application's id.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with settings(spark, **{CLEANUP: "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    blocks = _WRITTEN.get()[:-1] if kept else _WRITTEN.get()
    if blocks:
        blocks[-1].append(out)
    files, jvm_path = _file_system(spark, path)
    files.deleteOnExit(jvm_path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``materialize`` that no later plan reads."""
    for t in tables:
        files, path = _file_system(t.sparkSession, t.table_path)
        files.delete(path, True)
        files.cancelDeleteOnExit(path)
