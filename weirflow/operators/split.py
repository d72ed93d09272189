"""Class histograms, impurity and exact best splits of decision trees, as aggregates and windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut
from .prefix import CHUNK, chunked, scanned

#: Values no further apart count as one (fixed value).
GAP = 1e-7
#: Values that a task sums at a time, by the most that there may be.
PART_VALUES = 1_000_000


def class_histogram(df: DataFrame, node: str, label: str, weight: Column | None = None) -> DataFrame:
    """(node, label, weight, share) of rows with a weight other than zero."""
    w = F.lit(1.0) if weight is None else weight
    sums = df.where(w != 0).groupBy(node, label).agg(F.sum(w).alias("weight"))
    return sums.withColumn("share", F.col("weight") / F.sum("weight").over(W.partitionBy(node)))


def gini(df: DataFrame, node: str, label: str, weight: Column | None = None) -> DataFrame:
    """(node, gini, n): n is the weight of the node's rows, their number without weights."""
    counts = df.groupBy(node, label).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    return counts.groupBy(node).agg((F.lit(1.0) - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("gini"), F.sum("n").alias("n"))


def _next_value(chunks: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """chunks of distinct values with `above`, the next larger value of the key, also across the border of a chunk."""
    firsts = chunks.groupBy(*key, CHUNK).agg(F.min(value).alias("_first"))
    after = firsts.select(*key, CHUNK, F.lead("_first").over(W.partitionBy(*key).orderBy(CHUNK)).alias("_after"))
    inside = F.lead(value).over(W.partitionBy(CHUNK, *key).orderBy(value))
    return chunks.withColumn("_inside", inside).join(after, [*key, CHUNK]).withColumn("above", F.coalesce("_inside", "_after")).drop("_inside", "_after")


def adjacent_values(df: DataFrame, partition: Sequence[str], value: str, gap: float = GAP) -> DataFrame:
    """Distinct values with the next larger one, where they are further apart than the gap."""
    chunks = chunked(df.select(*partition, value).where(F.col(value).isNotNull()).distinct(), partition, [value])
    return _next_value(chunks, partition, value).select(*partition, value, F.col("above").alias("next_value")).where(F.col("next_value") - F.col(value) > gap)


def tallied(node: np.ndarray, place: np.ndarray, value: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(node, place, value, rows, weights of each class) of the different values of a batch; a class below 0 only counts as a row."""
    order = np.lexsort((value, place, node))
    node, place, value, y, w = node[order], place[order], value[order], y[order], w[order]
    new = np.ones(len(value), bool)
    new[1:] = (node[1:] != node[:-1]) | (place[1:] != place[:-1]) | (value[1:] != value[:-1])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    # a class without rows here gives whole zeros, whatever the weights are
    sums = [np.bincount(group[own], w[own], len(first)).astype(float) for own in (y == k for k in range(classes))]
    return node[first], place[first], value[first], np.bincount(group, minlength=len(first)), sums


def summed(tallies: DataFrame, classes: int, most: int) -> DataFrame:
    """The tallies of all batches (node, place, value, c, n0, ...), summed for each value by as many tasks as `most` values need."""
    dealt = tallies.repartition(max(1, -(-most // PART_VALUES)), "node", "place", "value")
    return dealt.groupBy("node", "place", "value").agg(F.sum("c").alias("c"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(classes)])


@dataclass
class Candidates:
    """rated: thresholds of nodes and features; spans: (node, place, low, high), the range of each feature's values in a node."""

    rated: DataFrame
    spans: DataFrame | None


def candidates(counts: DataFrame, classes: int, node: str = "node") -> Candidates:
    """From a written table (node, place, value, c, n0, ...), rows and class weights of each value: thresholds with the class weights to their left and right.

    The running sums of a node and feature, the root's too, are dealt over tasks by ranges of the
    value. nl, nr and n are weights, cl and cr numbers of rows.
    """
    key = [node, "place"]
    rows = scanned(counts, key, "value", ["c", *[f"n{i}" for i in range(classes)]], GAP)
    return Candidates(rated_rows(rows, classes, node), counts.groupBy(*key).agg(F.min("value").alias("low"), F.max("value").alias("high")))


def rated_rows(rows: DataFrame, classes: int, node: str) -> DataFrame:
    """The thresholds between each value and the next, from running sums (node, place, value, above, l_c, l_n0, ..., t_c, t_n0, ...)."""
    k = range(classes)
    left, all_ = lambda i: F.col(f"l_n{i}"), lambda i: F.col(f"t_n{i}")
    total = lambda e: sum((e(i) for i in k[1:]), e(0))
    square = lambda e: sum((e(i) * e(i) for i in k[1:]), e(0) * e(0))
    rows = rows.select(
        node, "place", "value", "above",
        total(all_).alias("n"), total(left).alias("nl"), F.col("l_c").cast("long").alias("cl"), (F.col("t_c") - F.col("l_c")).cast("long").alias("cr"),
        square(left).alias("_ql"), square(lambda i: all_(i) - left(i)).alias("_qr"), square(all_).alias("_q"),
        F.array(*[left(i) for i in k]).alias("left_weights"), F.array(*[all_(i) - left(i) for i in k]).alias("right_weights"),
    ).withColumn("nr", F.col("n") - F.col("nl"))
    middle = F.col("value") / 2 + F.col("above") / 2
    return rows.select(
        node, "place", F.when((middle == F.col("above")) | (F.abs(middle) == float("inf")), F.col("value")).otherwise(middle).alias("threshold"),
        "n", "nl", "nr", "cl", "cr", (F.col("_ql") / F.col("nl") + F.col("_qr") / F.col("nr")).alias("proxy"),
        (F.lit(1.0) - F.col("_q") / (F.col("n") * F.col("n"))).alias("impurity"),
        (F.lit(1.0) - F.col("_ql") / (F.col("nl") * F.col("nl"))).alias("impurity_left"), (F.lit(1.0) - F.col("_qr") / (F.col("nr") * F.col("nr"))).alias("impurity_right"),
        "left_weights", "right_weights",
    )


def split_candidates(df: DataFrame, node: str, features: Sequence[str], label: str, classes: Sequence[str], weight: str | None = None) -> DataFrame:
    """Every threshold of every node and feature of a table, with the feature's name; see candidates().

    Rows are summed for each value first, those of a batch before they are shuffled. Rows with a weight of zero and null
    values don't count.
    """
    rows = df if weight is None else df.where(F.col(weight) != 0)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    y = F.coalesce(F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int") - 1, F.lit(-1))
    rows = rows.select(F.col(node).alias("node"), y.alias("y"), w.alias("w"), *[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            coded = b["node"].dictionary_encode("encode")
            cols = [b[f"f{i}"] for i in range(len(features))]
            j, r = np.nonzero(np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in cols]))
            value = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in cols])[j, r]
            codes, place, value, c, sums = tallied(coded.indices.to_numpy()[r], j, value, b["y"].to_numpy()[r], b["w"].to_numpy()[r], len(classes))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(codes)), pa.array(place.astype(np.int32)), pa.array(value), pa.array(c), *map(pa.array, sums)], ["node", "place", "value", "c", *[f"n{i}" for i in range(len(classes))]])

    kind = rows.schema["node"].dataType.simpleString()
    tallies = rows.mapInArrow(run, f"node {kind}, place int, value double, c long, " + ", ".join(f"n{i} double" for i in range(len(classes))))
    counts = cut(summed(tallies, len(classes), df.count() * len(features)).withColumnRenamed("node", node))
    rated = candidates(counts, len(classes), node).rated
    return rated.select(node, F.get(F.array(*map(F.lit, features)), F.col("place")).alias("feature"), *[c for c in rated.columns if c != node])


def best_split(candidates: DataFrame, node: str, min_leaf: int = 1, min_weight_leaf: float = 0.0) -> DataFrame:
    """The candidate with the largest proxy of each node; equal ones: first feature, least threshold. Proxies are compared as they are."""
    order = F.struct((-F.col("proxy")).alias("p"), "place", "threshold")
    rest = [c for c in candidates.columns if c != node]
    allowed = (F.col("cl") >= min_leaf) & (F.col("cr") >= min_leaf) & (F.col("nl") >= min_weight_leaf) & (F.col("nr") >= min_weight_leaf)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # one row of each node: the aggregate below sorts its rows
            if b.num_rows:
                keys = pa.RecordBatch.from_arrays([b[node].dictionary_encode("encode").indices, *[b[c] for c in ("proxy", "place", "threshold")]], ["node", "proxy", "place", "threshold"])
                sorted_ = pc.sort_indices(keys, sort_keys=[("node", "ascending"), ("proxy", "descending"), ("place", "ascending"), ("threshold", "ascending")])
                yield b.take(sorted_.take(pa.array(np.unique(keys["node"].take(sorted_).to_numpy(), return_index=True)[1])))

    best = candidates.where(allowed).mapInArrow(leading, candidates.schema).groupBy(node).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(node, *[f"_best.{c}" for c in rest])


def gain(total: Column) -> Column:
    """Impurity improvement of a candidate, weighed by the node's share of all rows."""
    return F.col("n") / total * (F.col("impurity") - F.col("nr") / F.col("n") * F.col("impurity_right") - F.col("nl") / F.col("n") * F.col("impurity_left"))


def route(df: DataFrame, value: Column, threshold: Column) -> DataFrame:
    """Rows at most the threshold go left (0), others right (1)."""
    return df.withColumn("side", F.when(value <= threshold, 0).otherwise(1))
