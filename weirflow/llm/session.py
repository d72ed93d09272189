"""Size-checked broadcasts, joins that split hot keys, and written tables for the operators."""

from __future__ import annotations

import gc
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BROADCAST_BYTES, TABLE_ROW, cut, fresh, remove, shared_dir, small, table_path

__all__ = ["BROADCAST_BYTES", "TABLE_ROW", "cut", "fresh", "lookup", "release", "remove", "shared_dir", "small", "small_batches", "table_path", "written"]

#: Rows of one key that a join sends to one task.
TASK_ROWS = 10_000


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], times: str, how: str = "inner", row_bytes: int = 100, most: int | None = None) -> DataFrame:
    """left joined with right, which has each key once and in `times` how many rows of left have it.

    right is broadcast if it is small: if it has at most `most` rows by what the caller knows, else
    it is checkpointed and counted. If it is large, the rows of a hot key are dealt over several
    tasks by a hash of all their columns, and its row of right goes to each of these. Null keys meet
    nothing. The column `times` doesn't come back.
    """
    if most is None or most * (row_bytes + TABLE_ROW) > BROADCAST_BYTES:
        right = cut(right)
        most = right.count()
    if most * (row_bytes + TABLE_ROW) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right.drop(times)), list(keys), how)
    name = fresh(left, right)
    pieces, salt = name + "pieces", name + "salt"
    hot = cut(right.where(F.col(times) > TASK_ROWS).select(*keys, F.ceil(F.col(times) / TASK_ROWS).cast("int").alias(pieces)))
    spread = F.pmod(F.xxhash64(*left.columns), F.coalesce(pieces, F.lit(1))).cast("int")
    dealt = left.join(small(hot), list(keys), "left").withColumn(salt, spread).drop(pieces)
    many = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(times) / TASK_ROWS).cast("int"), F.lit(1)) - 1)))
    return dealt.join(many.drop(times).hint("merge"), [*keys, salt], how).drop(salt)


def written(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """The same as cut() by a compressed table, for what has many rows; its path is added to `made`."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Send Python workers at most 8 MB (or one row) at once, unless the cluster names a size.

    A batch is held several times, by both sides. Results are lazy and the setting is read when they
    are computed, so it stays for the session.
    """
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, "8m")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and checkpoints of frames that nothing refers to any more.

    It acts on garbage collections of the driver, which a long series of small jobs may not cause.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
