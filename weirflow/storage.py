"""The folder that all executors share: lineage cuts and written tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode, where it is unset, one of our own.

    On a cluster that names none this raises: no folder of the driver's machine can be read by executors.
    """
    sc = spark.sparkContext
    # Spark reads it with each checkpoint, from the context's own settings: a cut goes once no frame refers to it
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weirflow-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder: computed once, survives lost executors, deleted by Spark's cleaner after the last frame that reads it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A frame is broadcast only when it was measured and holds at most so much, with what a hash table adds to each row.
BROADCAST_BYTES, TABLE_ROW = 48 << 20, 100


def fits(df: DataFrame, row_bytes: int | Column = 100) -> bool:
    """Whether a checkpointed frame's rows, at row_bytes each, can be broadcast."""
    size = df.agg(F.sum((row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)) + TABLE_ROW).cast("long")).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def small(df: DataFrame, row_bytes: int | Column = 100) -> DataFrame:
    """Broadcast a checkpointed frame if its rows, at row_bytes each, fit; else it joins by a merge that AQE can split.

    The merge is asked for, since Spark takes a checkpoint's size from its plan, where an explode adds nothing.
    """
    return F.broadcast(df) if fits(df, row_bytes) else df.hint("merge")


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """A table that is read many times, written in the shared folder by columns, which scans read far faster than a cut; removed at the end."""
    spark = df.sparkSession
    path = table_path(spark, "rows")
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing will read again."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(*taken: DataFrame) -> str:
    """A prefix that no column of these frames begins with."""
    columns = [c.lower() for df in taken for c in df.columns]
    while True:
        name = f"w{uuid.uuid4().hex[:8]}_"
        if not any(c.startswith(name) for c in columns):
            return name


#: The JVM compiles no method of more bytes than this; Spark's own limit for a stage's code is far above (fixed value).
METHOD_BYTES = 8000


@contextmanager
def wide_plans(spark: SparkSession) -> Iterator[None]:
    """Plans of wide tables without inferred filters and without code too large to be compiled, restored at the end.

    Spark rewrites every filter for every column that a later projection renames, which doubles the
    set for each of them: a filter on all columns of a wide table takes longer to plan than to run.
    And it puts a stage over many columns into one method, which the JVM then interprets for each row;
    operators one by one, into which Spark falls back above this limit, are compiled.
    """
    set_ = {"spark.sql.constraintPropagation.enabled": "false", "spark.sql.codegen.hugeMethodLimit": str(METHOD_BYTES)}
    old = {name: spark.conf.get(name) for name in set_}
    for name, value in set_.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
