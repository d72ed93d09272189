"""Running sums and ranks over long sorted keys: a key of any size is dealt over several tasks.

Rows are range-partitioned by (key, order), so a key's rows lie in consecutive chunks. Each chunk is
summed by itself; what lies before it comes from one row for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut, fits

CHUNK = "_chunk"
#: Values that a chunk of scanned() holds, so that no task grows with their number.
CHUNK_ROWS = 250_000


def chunked(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with the number of the range partition of each row, checkpointed so that it is the same in every use."""
    ranged = df.repartitionByRange(*key, *order)
    return cut(ranged.withColumn(CHUNK, F.spark_partition_id()))


def upto(order: Sequence[str], key: Sequence[str]) -> W:
    """The window from a chunk's first row of a key to the current one."""
    return W.partitionBy(CHUNK, *key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def before(chunks: DataFrame, key: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """(key, chunk, sums of the chunks before it): one row for each key and chunk."""
    own = chunks.groupBy(*key, CHUNK).agg(*[c.alias(n) for n, c in sums.items()])
    earlier = W.partitionBy(*key).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return own.select(*key, CHUNK, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def _placed(chunks: DataFrame, at: DataFrame, key: Sequence[str]) -> DataFrame:
    """chunks with the row of `at` of their key and chunk; null keys are a key. The key and chunk of `at` don't come along."""
    names = {k: f"_k{i}" for i, k in enumerate([*key, CHUNK])}
    at = at.withColumnsRenamed(names)
    same = F.col(CHUNK) == F.col(names[CHUNK])
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(names[k]))
    return chunks.join(at, same).drop(*names.values())


def walked(df: DataFrame, key: Sequence[str], order: Sequence[str], change: Column, walk: str = "_walk", lowest: str = "_lowest") -> DataFrame:
    """df with the running sum of the changes of its key in this order, and the least that it has been so far.

    A chunk's effect is its sum and the lowest point of its own walk; these two are associative: after
    (s, l) comes (t, m) as (s + t, least(l, s + m)). A key of any size, or all rows if there is no key,
    is dealt over tasks; a row for each key and chunk is combined. Null changes count as 0.
    """
    chunks = chunked(df.withColumn("_change", F.coalesce(change.cast("long"), F.lit(0).cast("long"))), key, order)
    run = upto(order, key)
    inside = chunks.withColumn(walk, F.sum("_change").over(run)).withColumn(lowest, F.min(walk).over(run))
    sums = inside.groupBy(*key, CHUNK).agg(F.sum("_change").alias("_sum"), F.min(lowest).alias("_low"))
    earlier = W.partitionBy(*key).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*key, CHUNK, "_low", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    starts = starts.select(*key, CHUNK, "_start", F.min(F.col("_start") + F.col("_low")).over(earlier).alias("_before"))
    found = _placed(inside, starts, key)
    return found.select(*df.columns, (F.col("_start") + F.col(walk)).alias(walk), F.least("_before", F.col("_start") + F.col(lowest)).alias(lowest))


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "_rank") -> DataFrame:
    """df with the rank of each row within its key, from 1; rows that tie in order rank in any order. Null keys are a key."""
    chunks = chunked(df, key, order)
    at = before(chunks, key, {"_before": F.count(F.lit(1))})
    numbered = chunks.withColumn(name, F.row_number().over(W.partitionBy(CHUNK, *key).orderBy(*order)))
    return _placed(numbered, at, key).withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def scanned(df: DataFrame, key: Sequence[str], value: str, sums: Sequence[str], gap: float) -> DataFrame:
    """(key, value, above, l_*, t_*) of a written table of distinct values of a key: the next larger value, where it is further off than the gap, running sums up to the value, and the key's sums.

    Chunks of a bounded number of values lie sorted in a written table. A task reads its chunk in
    order, batch by batch, and carries the sums and the last value along; what lies before and behind
    the chunk comes from one row for each key and chunk.
    """
    whole = df.select(*key, F.col(value).cast("double").alias(value), *[F.col(s).cast("double").alias(s) for s in sums])
    parts = max(1, -(-whole.count() // CHUNK_ROWS))
    chunks = cut(whole.repartitionByRange(parts, *key, value).sortWithinPartitions(*key, value).withColumn(CHUNK, F.spark_partition_id()))
    edges = chunks.groupBy(*key, CHUNK).agg(F.min(value).alias("_first"), *[F.sum(s).alias(s) for s in sums])
    ordered, all_ = W.partitionBy(*key).orderBy(CHUNK), W.partitionBy(*key)
    starts = edges.select(*key, CHUNK, F.lead("_first").over(ordered).alias("_after"), *[F.coalesce(F.sum(s).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias(f"b_{s}") for s in sums], *[F.sum(s).over(all_).alias(f"t_{s}") for s in sums])
    starts = cut(starts.withColumn("_group", F.monotonically_increasing_id()))
    if fits(starts, 40 + 40 * len(key) + 16 * len(sums)):
        placed = _placed(chunks, F.broadcast(starts), key)  # keeps the order of the chunks
    else:
        placed = _placed(chunks, starts.hint("merge"), key).repartition(parts, CHUNK).sortWithinPartitions(CHUNK, *key, value)
    names, kept = [f"l_{s}" for s in sums], [*key, value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: its successor may be in the next batch

        def out(rows: pa.RecordBatch, above: np.ndarray, known: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
            far = np.flatnonzero(known & ~(above - rows[value].to_numpy() <= gap))
            own = rows.take(pa.array(far))
            return pa.RecordBatch.from_arrays([*[own[c] for c in kept], pa.array(above[far]), *[pa.array(left[far, i]) for i in range(len(sums))], *[own[f"t_{s}"] for s in sums]], [*kept, "above", *names, *[f"t_{s}" for s in sums]])

        for b in batches:
            if not b.num_rows:
                continue
            group, v = b["_group"].to_numpy(), b[value].to_numpy()
            own, before_ = (np.stack([b[p + s].to_numpy() for s in sums], 1) if sums else np.zeros((len(v), 0)) for p in ("", "b_"))
            left, firsts = np.empty_like(own), np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for a, e in zip(firsts, [*firsts[1:], len(v)], strict=True):
                start = held[3] if held and a == 0 and held[2] == group[0] else before_[a]
                left[a:e] = np.cumsum(np.vstack([start, own[a:e]]), axis=0)[1:]
            above, known = b["_after"].to_numpy(zero_copy_only=False).astype(float), b["_after"].is_valid().to_numpy(zero_copy_only=False)
            same = np.r_[group[1:] == group[:-1], False]
            above, known = np.where(same, np.r_[v[1:], 0.0], above), known | same
            if held:
                follows = held[2] == group[0]
                yield out(held[0], np.array([v[0]]) if follows else held[1][0], np.array([True]) if follows else held[1][1], held[3][None])
            if len(v) > 1:
                yield out(b.slice(0, len(v) - 1), above[:-1], known[:-1], left[:-1])
            held = (b.slice(len(v) - 1), (above[-1:], known[-1:]), group[-1], left[-1])
        if held:
            yield out(held[0], *held[1], held[3][None])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in key], f"`{value}` double", "above double", *[f"{n} double" for n in names], *[f"t_{s} double" for s in sums]])
    return placed.mapInArrow(run, schema)
