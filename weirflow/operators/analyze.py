"""Variance, correlation and importance of features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut, wide_plans


_MOMENTS = "i int, j int, n double, mi double, mj double, vi double, vj double, c double"


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each pair of columns j <= i of a partition, over its rows with values in both: their number, means, and squares and products around the means."""
    shift = n = s = q = p = None
    for b in batches:
        x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns], axis=1)
        here = ~np.isnan(x)
        if shift is None:
            k = x.shape[1]
            shift, (n, s, q, p) = np.full(k, np.nan), np.zeros((4, k, k))
        # a column's first value is taken off, so that large means cost no digits and constants are 0
        new = np.isnan(shift) & here.any(axis=0)
        shift[new] = x[here.argmax(axis=0), np.arange(len(shift))][new]
        z, m = np.where(here, x - shift, 0.0), here.astype(float)
        n, s, q, p = n + m.T @ m, s + z.T @ m, q + (z * z).T @ m, p + z.T @ z
    if shift is None:
        return
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = s / n
        i, j = np.nonzero(np.tri(len(shift), dtype=bool) & (n > 0))
        mi, mj = mean[i, j], mean[j, i]
        v = q - s * mean
        columns = [i.astype(np.int32), j.astype(np.int32), n[i, j], shift[i] + mi, shift[j] + mj, v[i, j], v[j, i], p[i, j] - n[i, j] * mi * mj]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _MOMENTS.split(", ")])


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, vi, vj, c) for each pair of columns j <= i by their places, from one scan: rows with values in both, squares and products around the means.

    Nulls and NaN count as missing for the pairs of their column only. Every partition sums a matrix
    of its own; these are merged by the differences of their means. The result has the square of the
    number of columns, whatever the rows.
    """
    with wide_plans(df.sparkSession):
        x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
        parts = x.mapInArrow(_moments, _MOMENTS)
        pair = W.partitionBy("i", "j")
        mean = lambda m: F.sum(F.col("n") * F.col(m)).over(pair) / F.sum("n").over(pair)
        parts = parts.withColumns({"di": F.col("mi") - mean("mi"), "dj": F.col("mj") - mean("mj"), "size": F.abs(mean("mi")), "size_j": F.abs(mean("mj"))})
        total = lambda v, d, e: F.sum(F.col(v) + F.col("n") * F.col(d) * F.col(e))
        sums = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), total("vi", "di", "di").alias("vi"), total("vj", "dj", "dj").alias("vj"), total("c", "di", "dj").alias("c"), F.max("size").alias("size"), F.max("size_j").alias("size_j"))
        # what the last digit of equal values makes is no variance
        real = lambda v, size: F.when(F.col(v) > F.col("n") * F.pow(F.col(size) * 1e-14, 2), F.col(v)).otherwise(F.when(F.isnan(v), F.col(v)).otherwise(0.0))
        return cut(sums.select("i", "j", "n", real("vi", "size").alias("vi"), real("vj", "size_j").alias("vj"), "c"))


def variances(found: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, variance) from moments(); the sample variance of one value or none is null."""
    names = F.array(*map(F.lit, cols))
    return found.where("i = j").select(F.get(names, F.col("i")).alias("feature"), F.when(F.col("n") > 1, F.col("vi") / (F.col("n") - 1)).alias("variance"))


def pair_correlations(found: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, r) of all pairs, the later column first, from moments(); without variance in the pair's rows r is null."""
    names, spark = F.array(*map(F.lit, cols)), found.sparkSession
    pairs = spark.createDataFrame([(i, j) for i in range(len(cols)) for j in range(i)], "i int, j int")
    r = F.when((F.col("vi") > 0) & (F.col("vj") > 0), F.col("c") / F.sqrt(F.col("vi")) / F.sqrt(F.col("vj")))
    return pairs.join(found, ["i", "j"], "left").select(F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), F.when(~F.isnan(r), r).alias("r"))


def low_variance(df: DataFrame, cols: Sequence[str], below: float = 0.01) -> DataFrame:
    """(feature, variance) with a sample variance below the limit, from one aggregate."""
    one = df.agg(*[F.var_samp(f"`{c}`").alias(c) for c in cols])
    return one.unpivot([], list(cols), "feature", "variance").where(F.col("variance") < below)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, r) for all pairs, a later column first: Pearson's correlation over the rows with values in both, from one scan."""
    return pair_correlations(moments(df, cols), cols)


def correlated_to_drop(pairs: Sequence[tuple[str, str, float]], order: Sequence[str], above: float = 0.95) -> list[str]:
    """Columns in order, each dropped if it correlates (positively) with an earlier one; few columns, so on the driver."""
    place = {c: i for i, c in enumerate(order)}
    found = {max(a, b, key=place.__getitem__) for a, b, r in pairs if r is not None and r > above}
    return [c for c in order if c in found]


def analyse(df: DataFrame, cols: Sequence[str], variance: float = 0.01) -> tuple[list[str], DataFrame]:
    """(columns with a sample variance below the limit, correlations of all pairs), both from one scan."""
    found = moments(df, cols)
    flat = {r.feature for r in variances(found, cols).where(F.col("variance") < variance).collect()}  # one row for each column at most
    return [c for c in cols if c in flat], pair_correlations(found, cols)


def kept_features(df: DataFrame, cols: Sequence[str], variance: float = 0.01, above: float = 0.95) -> list[str]:
    flat, pairs = analyse(df, cols, variance)
    drop = set(correlated_to_drop([tuple(r) for r in pairs.collect()], cols, above))
    return [c for c in cols if c not in drop and c not in flat]


def select_by_importance(importance: DataFrame, least: float = 0.01) -> DataFrame:
    return importance.where(F.col("importance") >= least)
