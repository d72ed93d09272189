"""Request metrics over a table of requests (ts, duration, status, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import ranked, walked

KEPT_DURATIONS = 1000
KEPT_SECONDS = 3600


def requests_per_minute(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.date_format(F.date_trunc("minute", ts), "yyyy-MM-dd HH:mm").alias("minute")).agg(F.count(F.lit(1)).alias("requests"))


def last_durations(df: DataFrame, order: Sequence[str], n: int = KEPT_DURATIONS) -> DataFrame:
    """The n latest rows: a top-k, so no global sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def last_n_average(df: DataFrame, value: str, order: Sequence[str], n: int = KEPT_DURATIONS) -> DataFrame:
    return last_durations(df, order, n).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("avg_duration"), F.count(F.lit(1)).alias("n"))


def rolling_average(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str], n: int = KEPT_DURATIONS) -> DataFrame:
    """Mean over each row and the n - 1 before it, for each key; null values don't count.

    A key's rows are cut into blocks of n. A window is the end of one block and the beginning of the
    next, so its sum is a running sum from the end of the block before plus one from the beginning of
    its own: nothing is taken off again, and NaN, infinities and values of very different sizes leave
    the mean when they leave the window. A key of any size is dealt over tasks by its blocks, and a
    row costs the same for any n.
    """
    rows = ranked(df, key, order).withColumn("_block", F.floor((F.col("_rank") - 1) / n))
    whole = rows.select(*key, "_rank", "_block", F.col(f"`{value}`").cast("double").alias("_v"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    # to its own block with all columns, to the next one with its value
    dealt = whole.withColumn("_in", F.explode(F.array("_block", F.col("_block") + 1))).withColumn("_row", F.when(F.col("_in") == F.col("_block"), F.col("_row")))
    dealt = dealt.repartition(*key, "_in")
    block = W.partitionBy(*key, "_in", "_block")
    upto = block.orderBy("_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = block.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = dealt.withColumns({"_sum": F.sum("_v").over(upto), "_count": F.count("_v").over(upto)}).withColumns({"_end": F.struct(F.sum("_v").over(rest).alias("sum"), F.count("_v").over(rest).alias("count"))})
    both = W.partitionBy(*key, "_in").orderBy("_rank")
    found = summed.withColumn("_end", F.lag("_end", n - 1).over(both) if n > 1 else F.lit(None).cast(summed.schema["_end"].dataType)).where("_in = _block")
    # the last row of a block has its whole window in the block
    end = F.when(F.col("_rank") % n != 0, F.col("_end"))
    total = F.coalesce("_sum", F.lit(0.0)) + F.coalesce(end["sum"], F.lit(0.0))
    mean = F.try_divide(total, F.col("_count") + F.coalesce(end["count"], F.lit(0)))
    return found.select("_row.*", mean.alias("rolling_avg"))


def live_minutes(minutes: DataFrame, now: Column, seconds: int = KEPT_SECONDS) -> DataFrame:
    """Minutes no older than `seconds` from their start, strictly older ones are dropped."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("minute", "yyyy-MM-dd HH:mm"))
    return minutes.withColumn("age", age).where(F.col("age") <= seconds)


def running_gauge(df: DataFrame, key: Sequence[str], change: Column, order: Sequence[str]) -> DataFrame:
    """Running sum of changes (gauge) and the same floored at 0 (active): a floored walk is the walk less its lowest point below 0.

    The order should identify the rows of a key. A key with all rows is dealt over tasks.
    """
    rows = walked(df, key, order, change, "gauge", "_lowest")
    return rows.withColumn("active", F.col("gauge") - F.least(F.lit(0), "_lowest")).drop("_lowest")


def current_minute(df: DataFrame, now: Column, ts: str = "ts") -> DataFrame:
    """(minute, requests): one row, the requests of the minute that `now` lies in, 0 if there are none."""
    asked = df.sparkSession.range(1).select(F.date_format(F.date_trunc("minute", now), "yyyy-MM-dd HH:mm").alias("minute"))
    return asked.join(requests_per_minute(df, ts), "minute", "left").select("minute", F.coalesce("requests", F.lit(0).cast("long")).alias("requests"))


def snapshot(df: DataFrame, value: str, error: Column, order: Sequence[str], ts: str = "ts") -> DataFrame:
    """One row: total_requests, errors, avg_duration of the last 1000, requests_per_minute of the latest minute."""
    totals = df.agg(F.count(F.lit(1)).alias("total_requests"), F.count_if(error).alias("errors"))
    minute = df.groupBy(F.date_trunc("minute", ts).alias("_minute")).agg(F.count(F.lit(1)).alias("_n"))
    rate = minute.agg(F.coalesce(F.max_by("_n", "_minute"), F.lit(0).cast("long")).alias("requests_per_minute"))
    # one row each
    return totals.crossJoin(F.broadcast(last_n_average(df, value, order).select("avg_duration"))).crossJoin(F.broadcast(rate))


def status_json(snapshots: DataFrame, uptime: Column, resources: Column | None = None) -> DataFrame:
    """`status`: the JSON document of a running server from its snapshot: status, uptime in seconds, metrics, resources."""
    parts = [F.lit("running").alias("status"), uptime.alias("uptime"), F.struct(*snapshots.columns).alias("metrics")]
    return snapshots.select(F.to_json(F.struct(*parts, *([] if resources is None else [resources.alias("resources")]))).alias("status"))
