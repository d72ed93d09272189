"""Cleaning of flow tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Identifiers, metadata and redundant columns that are never features (fixed values).
REMOVE = (
    "Flow ID",
    "Src IP",
    "Dst IP",
    "Src Port",
    "Dst Port",
    "Protocol",
    "Timestamp",
    "Fwd Segment Size Avg",
    "Bwd Segment Size Avg",
    "Fwd IAT Total",
    "Bwd PSH Flags",
    "Fwd URG Flags",
)
#: Labels used in training (fixed values).
LABELS = ("BENIGN", "DoS Hulk", "DoS GoldenEye", "DoS slowloris")


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without these columns; one that doesn't exist is an error."""
    if missing := [c for c in names if c not in df.columns]:
        raise KeyError(f"no such columns: {missing}")
    return df.drop(*names)


def infinite_to_null(df: DataFrame) -> DataFrame:
    """Infinities and NaN become null."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def clean(c: str):
        x = F.col(f"`{c}`")
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x).alias(c) if c in floats else x

    return df.select(*[clean(c) for c in df.columns])


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n_null) of columns with nulls, from one aggregate over the table."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "n_null").where("n_null > 0")


def keep_labels(df: DataFrame, col: str, labels: Sequence[str]) -> DataFrame:
    return df.where(F.col(col).isin(*labels))


def clean_flows(df: DataFrame, label: str | None = "Label", labels: Sequence[str] = LABELS, remove: Sequence[str] = REMOVE) -> DataFrame:
    """Training: nulls and whole-row repeats go first, then other labels, then identifiers.

    The label filter commutes with both, so it is applied before the shuffle of the distinct.
    label None: no filter (detection).
    """
    rows = drop_any_null(infinite_to_null(df))
    if label:
        rows = keep_labels(rows, label, labels)
    return drop_columns(rows.dropDuplicates(), remove)
