"""Exact decision trees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written
from .forest import label_index, max_features
from .grow import EPSILON, Rules, flat, grow, node_table

__all__ = ["EPSILON", "Tree", "checked_rows"]


def checked_rows(df: DataFrame, features: Sequence[str], label: str, weight: str | None, *more: str) -> DataFrame:
    """(*more, x, _label, w) of the rows that a tree is grown on: features as float32 values, weights as doubles.

    A feature or weight that isn't a number is an error. Rows with a null feature or label, or
    without weight, are left out; a weight below zero is an error when it is read.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    wrong = [c for c in [*features, *([weight] if weight else [])] if not isinstance(kinds.get(c), (T.NumericType, T.BooleanType))]
    if wrong or label not in kinds or not features:
        raise TypeError(f"not a number, or no such column: {wrong or label}")
    w = F.lit(1.0) if weight is None else F.col(f"`{weight}`").cast("double")
    w = F.when(w < 0, F.raise_error(F.lit("a weight is below zero")).cast("double")).otherwise(w)
    x = F.array(*[F.col(f"`{f}`").cast("float").cast("double") for f in features])
    rows = df.select(*more, x.alias("x"), F.col(f"`{label}`").alias("_label"), w.alias("w"))
    known = F.col("_label").isNotNull() & (F.coalesce("w", F.lit(0.0)) != 0)
    for i in range(len(features)):
        known &= F.get("x", F.lit(i)).isNotNull() & ~F.isnan(F.get("x", F.lit(i)))
    return rows.where(known)


@dataclass
class Tree:
    """Parameters of a tree; fit() gives its node table. Impurity is Gini.

    max_depth None: grown until nothing can be split. min_weight_fraction_leaf is a share of the
    weight of all rows. max_features: "sqrt", "log2", a number, a share, or None for all.
    """

    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    min_weight_fraction_leaf: float = 0.0
    max_features: str | int | float | None = None
    min_impurity_decrease: float = 0.0
    random_state: int = 0
    classes: list[str] = field(default_factory=list)

    def rules(self, features: int, trees: int = 1) -> Rules:
        subset = max_features(self.max_features, features)
        return Rules(self.max_depth, self.min_samples_split, self.min_samples_leaf, self.min_weight_fraction_leaf, subset, self.min_impurity_decrease, [self.random_state + t for t in range(trees)], subset < features)

    def fit(self, df: DataFrame, features: Sequence[str], label: str, weight: str | None = None) -> DataFrame:
        """The nodes, numbered in pre-order, with `feature_name`; a value is the share of each class, in the order of `classes`.

        What comes to the driver is the model, of bounded size (see grow.MODEL_NODES). The rows are written
        into the shared folder once and read for each level. See checked_rows() for nulls; no rows, no nodes.
        """
        rows = checked_rows(df, features, label, weight)
        with written(rows.select(*flat(len(features)), "_label", "w")) as rows:
            self.classes = [r[0] for r in label_index(rows, "_label").orderBy("code").collect()]
            coded = rows.withColumn("y", F.array_position(F.array(*map(F.lit, self.classes)), F.col("_label")).cast("int") - 1) if self.classes else rows.withColumn("y", F.lit(0))
            return node_table(df, grow(coded, len(features), max(1, len(self.classes)), self.rules(len(features))), features)
