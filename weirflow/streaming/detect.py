"""Streaming forms: detection for each micro-batch, and request metrics with bounded state."""

from __future__ import annotations

import logging
import os
import time
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.features import engineer
from ..operators.clean import REMOVE, clean_flows
from ..operators.evaluate import label_counts
from ..operators.forest import load_forest, score
from ..operators.metrics import KEPT_DURATIONS, KEPT_SECONDS
from ..operators.prefix import walked
from ..sources.flows import metrics_message, read_files
from ..storage import remove as remove_paths
from ..storage import wide_plans

LOG = logging.getLogger(__name__)


def _start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, period: str | None) -> StreamingQuery:
    """period: time between micro-batches; None takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)).start()


def detect(stream: DataFrame, predict: Callable[[DataFrame], DataFrame], labels: Sequence[str], sink: str, checkpoint: str, *, remove: Sequence[str] = REMOVE, period: str | None = None, rows: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Cleans, scores and counts each micro-batch by itself into a Parquet folder (batch_id, label, n).

    rows: the flows of a micro-batch, if the stream doesn't hold them itself. A column Label takes part
    in dropping nulls and repeats and goes then. Repeats are dropped within a batch only. A batch that
    is run again overwrites its own folder. A batch without rows gives zeros.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        flows = rows(df) if rows else df
        gone = [*remove, *(["Label"] if "Label" in flows.columns else [])]
        with wide_plans(df.sparkSession):
            scored = predict(clean_flows(flows, label=None, remove=gone)).select(F.col("label_predicted").alias("label"))
            label_counts(scored, "label", labels).select(F.lit(batch_id).alias("batch_id"), "label", "n").coalesce(1).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(stream, batch, checkpoint, period)


def detect_files(stream: DataFrame, schema: T.StructType | None, predict: Callable[[DataFrame], DataFrame], labels: Sequence[str], sink: str, checkpoint: str, **options) -> StreamingQuery:
    """detect() over a stream of paths (stream_files): each file's columns by its header. A batch has as many paths as the stream asks for."""
    return detect(stream, predict, labels, sink, checkpoint, rows=lambda df: read_files(df.sparkSession, [r.path for r in df.collect()], schema), **options)


def model_predictor(spark: SparkSession, path: str) -> tuple[Callable[[DataFrame], DataFrame], list[str]]:
    """(predict for detect(), labels) of a saved forest: derived features, then the model's own by name."""
    model, features, classes = load_forest(spark, path)
    return lambda df: score(model, engineer(df), features, classes), classes


def clear(spark: SparkSession, *paths: str) -> None:
    """Remove what earlier runs left: sinks, checkpoints, captures."""
    remove_paths(spark, *paths)


def minute_counts(stream: DataFrame, ts: str = "ts", late: str = f"{KEPT_SECONDS} seconds") -> DataFrame:
    """Requests for each minute of event time; the state of minutes older than the watermark is dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, "1 minute")).agg(F.count(F.lit(1)).alias("requests")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("minute"), "requests")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


MINUTE = 60_000_000


class _Slices(StatefulProcessor):
    """One row of a key and slice of time for what a micro-batch holds of them; keeps nothing."""

    def __init__(self, key: str, kept: int, seconds: int):
        self.key, self.kept, self.seconds = key, kept, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("ts", kind="stable")
        walk = np.cumsum(own["change"].fillna(0).to_numpy(np.int64))
        closed = own[own["change"] < 0]
        at = closed["ts"].astype("datetime64[us]").astype(np.int64).to_numpy()
        starts, counts = np.unique(at - at % MINUTE, return_counts=True)
        live = _micros(own["ts"].max()) - starts <= self.seconds * 1_000_000
        yield pd.DataFrame({
            self.key: [key[0]], "newest": [own["ts"].max()], "requests": [len(closed)], "errors": [int((closed["status"] >= 400).sum())], "moved": [int(walk[-1])], "low": [int(walk.min())],
            "durations": [closed["duration"].dropna().to_numpy(float)[-self.kept :].tolist()], "starts": [starts[live].tolist()], "counts": [counts[live].tolist()],
        })

    def close(self) -> None:
        pass


_SLICE = "newest timestamp, requests long, errors long, moved long, low long, durations array<double>, starts array<long>, counts array<long>"
_STATE = "total_requests long, errors long, active long, avg_duration double, requests_per_minute long, minutes map<string, long>"


class _Server(StatefulProcessor):
    """A key's counters, its last durations in blocks, and the requests of its last minutes."""

    BLOCK = 100

    def __init__(self, key: str, kept: int, seconds: int):
        self.key, self.kept, self.seconds = key, kept, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "total long, errors long, active long, seen long, newest long")
        self.blocks = handle.getMapState("blocks", "block long", "durations array<double>")
        self.minutes = handle.getMapState("minutes", "minute long", "requests long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        total, errors, active, seen, newest = self.totals.get() if self.totals.exists() else (0, 0, 0, 0, 0)
        durations: list[float] = []
        added: Counter[int] = Counter()
        for r in pd.concat(list(rows)).sort_values("newest", kind="stable").itertuples():
            # what a floored gauge does in a slice follows from the slice's sum and lowest point
            active = active + r.moved - min(0, active + r.low)
            total, errors, newest = total + r.requests, errors + r.errors, max(newest, _micros(r.newest))
            durations = [*durations, *r.durations][-self.kept :]
            added.update(dict(zip(map(int, r.starts), map(int, r.counts), strict=True)))
        seen = self._append(int(seen), durations)
        self._count(added, int(newest))
        self.totals.update((int(total), int(errors), int(active), seen, int(newest)))
        yield self._row(key)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """Minutes of a key without new requests go when the watermark is past them."""
        start = (expiredTimerInfo.getExpiryTimeInMs() - 1 - self.seconds * 1000) * 1000
        if not self.minutes.containsKey((start,)):
            return
        self.minutes.removeKey((start,))
        yield self._row(key)

    def _append(self, seen: int, durations: Sequence[float]) -> int:
        """Durations go to blocks by their number; the blocks that they fill are written, those that no kept one is in removed."""
        end, block = seen + len(durations), seen // self.BLOCK
        while durations:
            own = self.blocks.getValue((block,))[0] if seen % self.BLOCK else []
            room = self.BLOCK - len(own)
            self.blocks.updateValue((block,), ([*map(float, own), *durations[:room]],))
            seen, durations, block = seen + len(durations[:room]), durations[room:], block + 1
        for (old,) in list(self.blocks.keys()):
            if (old + 1) * self.BLOCK <= end - self.kept:
                self.blocks.removeKey((old,))
        return end

    def _count(self, added: Mapping[int, int], newest: int) -> None:
        """Counts of new minutes are added to the old; those that start too long before the newest row go or never come."""
        known = {k[0]: v[0] for k, v in self.minutes.iterator()}
        live = lambda start: newest - start <= self.seconds * 1_000_000
        for start in known:
            if not live(start):
                self.minutes.removeKey((start,))
        for start, n in added.items():
            if live(start):
                self.minutes.updateValue((start,), (n + known.get(start, 0),))
                if start not in known:
                    self.handle.registerTimer(start // 1000 + self.seconds * 1000 + 1)

    def _row(self, key: tuple) -> pd.DataFrame:
        total, errors, active, _, newest = self.totals.get()
        blocks = sorted((k[0], list(v[0])) for k, v in self.blocks.iterator())
        durations = [d for _, own in blocks for d in own][-self.kept :]
        counts = {k[0]: v[0] for k, v in self.minutes.iterator()}
        named = {datetime.fromtimestamp(k // 1_000_000, UTC).strftime("%Y-%m-%d %H:%M"): n for k, n in counts.items()}
        mean = float(np.mean(durations)) if durations else 0.0
        return pd.DataFrame({self.key: [key[0]], "total_requests": [total], "errors": [errors], "active": [active], "avg_duration": [mean], "requests_per_minute": [counts.get(newest - newest % MINUTE, 0)], "minutes": [named]})

    def close(self) -> None:
        pass


def _micros(t: pd.Timestamp) -> int:
    return pd.Timestamp(t).value // 1000


def server_state(stream: DataFrame, key: str, *, kept: int = KEPT_DURATIONS, seconds: int = KEPT_SECONDS, late: str = f"{KEPT_SECONDS} seconds", slice_seconds: int = 60) -> DataFrame:
    """Counters, the floored gauge, the mean of the last `kept` durations and the requests of the last minutes of each key, after each micro-batch with rows of it.

    stream: (key, ts, duration, status, change); change is +1 for an opened and -1 for a closed request.
    requests_per_minute is that of the minute of the key's latest row; a minute whose start is more than
    `seconds` older than that row goes, and those of a silent key when the watermark is past them. Minutes
    are named in UTC. Rows without a ts are left out, null durations don't count, a null change neither
    opens nor closes.

    Two steps: a key's rows of one slice of time come down to one row, so that a hot key's batch is
    dealt over tasks by its slices; a key's state then takes a row for each slice. It is kept in
    RocksDB, and only what a batch changes is written: of `kept` durations the blocks that new ones fill.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col("ts").cast("timestamp").alias("ts"), F.col("duration").cast("double").alias("duration"), "status", "change").where("ts IS NOT NULL").withWatermark("ts", late)
    sliced = rows.withColumn("_slice", F.floor(F.unix_seconds("ts") / slice_seconds)).groupBy(key, "_slice")
    slices = sliced.transformWithStateInPandas(_Slices(key, kept, seconds), f"{key} {kind}, {_SLICE}", "append", "None", eventTimeColumnName="newest")
    return slices.groupBy(key).transformWithStateInPandas(_Server(key, kept, seconds), f"{key} {kind}, {_STATE}", "append", "EventTime")


_SHOT = "batch_id long, total_requests long, errors long, active long, avg_duration double, requests_per_minute long, minutes map<string, long>"


def snapshots(stream: DataFrame, value: str, error: Column, order: Sequence[str], sink: str, checkpoint: str, *, ts: str = "ts", change: Column | None = None, period: str | None = None, kept: int = KEPT_DURATIONS, seconds: int = KEPT_SECONDS) -> StreamingQuery:
    """A snapshot for each period in the folder sink/batch=n: total_requests, errors, active, avg_duration of the last `kept`, requests_per_minute of the latest minute, minutes.

    active is the gauge of `change` floored at 0 (0 without it), by a scan that deals the batch over
    tasks; minutes maps the minutes of the last `seconds` to their requests. Null values don't count in
    the mean, rows without a ts in no minute. The state that batch n leaves is one row in
    sink/_state/batch=n, made from that of batch n - 1 and the batch's own totals, so a batch that is
    run again gives the same rows; older states are removed.
    """
    schema = _SHOT + ", latest array<double>"

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        own = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(error).alias("e"), F.max(ts).alias("now")).first()
        last = df.where(F.col(value).isNotNull()).orderBy(*[F.desc(c) for c in order]).limit(kept).select(F.col(value).cast("double").alias("value")).collect()
        counted = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc("minute", ts).alias("m")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("m")).limit(seconds // 60 + 1).collect()
        old = spark.read.schema(schema).parquet(f"{sink}/_state/batch={batch_id - 1}").first() if batch_id > 0 else None
        latest = ((old.latest if old else []) + [r.value for r in reversed(last)])[-kept:]
        minutes = dict(old.minutes) if old else {}
        for r in counted:
            name = r.m.strftime("%Y-%m-%d %H:%M")
            minutes[name] = minutes.get(name, 0) + r.n
        if minutes:
            newest = max(pd.Timestamp(max(minutes)), *([pd.Timestamp(own.now).tz_localize(None)] if own.now is not None else []))
            minutes = {m: n for m, n in minutes.items() if (newest - pd.Timestamp(m)).total_seconds() <= seconds}
        active = old.active if old else 0
        if change is not None:
            moved = walked(df, [], order, change).agg(F.max_by("_walk", F.struct(*order)).alias("sum"), F.min("_lowest").alias("low")).first()
            active += (moved.sum or 0) - min(0, active + (moved.low or 0))
        mean = sum(latest) / len(latest) if latest else 0.0
        row = (batch_id, (old.total_requests if old else 0) + own.n, (old.errors if old else 0) + own.e, active, mean, minutes[max(minutes)] if minutes else 0, minutes)
        spark.createDataFrame([(*row, latest)], schema).coalesce(1).write.mode("overwrite").parquet(f"{sink}/_state/batch={batch_id}")
        spark.createDataFrame([row], _SHOT).coalesce(1).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        if batch_id > 1:
            remove_paths(spark, f"{sink}/_state/batch={batch_id - 2}")

    return _start(stream, batch, checkpoint, period)


def latest_snapshot(spark: SparkSession, sink: str) -> DataFrame:
    """The newest row of snapshots(); no row before the first."""
    try:
        shots = spark.read.schema(_SHOT).parquet(sink)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SHOT)
    return shots.orderBy(F.desc("batch_id")).limit(1).drop("batch")


def monitor(spark: SparkSession, shots: str, sink: str, checkpoint: str, *, period: str = "2 seconds", sample: Callable[[], dict[str, float]] | None = None, backoff: float = 5.0) -> StreamingQuery:
    """Every period a row (at, uptime, cpu_percent, memory_mb, message, status) in sink/batch=n, until it is stopped.

    It joins a sample of this process's resources and its time since the start with the newest
    snapshot in `shots` (zeros before the first): message is the metrics' log line, status the JSON
    document of a running server. A sample or read that fails is logged and skipped, and the next one
    waits `backoff` seconds.
    """
    began, take = time.time(), sample or resources
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def batch(df: DataFrame, batch_id: int) -> None:
        session = df.sparkSession
        try:
            used = take()
            at, zeros = time.time(), session.createDataFrame([(-1, 0, 0, 0, 0.0, 0, {})], _SHOT)
            shot = latest_snapshot(session, shots).unionAll(zeros).orderBy(F.desc("batch_id")).limit(1)
            row = shot.withColumns({"at": F.timestamp_seconds(F.lit(at)), "uptime": F.lit(at - began), **{k: F.lit(float(v)) for k, v in used.items()}})
            metrics = ["total_requests", "active", "avg_duration", "requests_per_minute", "errors"]
            status = F.to_json(F.struct(F.lit("running").alias("status"), "uptime", F.struct(*metrics).alias("metrics"), F.struct(*used).alias("resources")))
            row.select("at", "uptime", *used, metrics_message(row).alias("message"), status.alias("status")).coalesce(1).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        except Exception:
            LOG.exception("no sample in batch %d", batch_id)
            time.sleep(backoff)

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()


def resources(seconds: float = 0.1) -> dict[str, float]:
    """cpu_percent over a short while and memory_mb of this process, for the status document."""
    used, began = sum(os.times()[:2]), time.perf_counter()
    time.sleep(seconds)
    share = (sum(os.times()[:2]) - used) / max(time.perf_counter() - began, 1e-9)
    with open("/proc/self/statm") as f:
        pages = int(f.read().split()[1])
    return {"cpu_percent": 100 * share, "memory_mb": pages * os.sysconf("SC_PAGE_SIZE") / (1 << 20)}
