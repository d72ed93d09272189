"""The two programs: train a detector from flow files, and detect with it on a stream of flow files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .functions.features import engineer
from .operators import analyze, evaluate, forest
from .operators.clean import LABELS, REMOVE, clean_flows, infinite_to_null, null_counts
from .sources.flows import stream_files
from .storage import cut, wide_plans, written
from .streaming.detect import detect_files, model_predictor


@dataclass
class Trained:
    """What a training run found; frames are small but for `predictions`."""

    missing: DataFrame
    low_variance: list[str]
    correlated: DataFrame
    dropped: list[str]
    importances: DataFrame
    selected: list[str]
    classes: list[str]
    predictions: DataFrame
    report: DataFrame
    confusion: DataFrame


def train(train: DataFrame, test: DataFrame, path: str, *, label: str = "Label", labels: Sequence[str] = LABELS, remove: Sequence[str] = REMOVE, trees: int = 100, depth: int = 20, seed: int = 42, least_importance: float = 0.01, variance: float = 0.01, above: float = 0.95) -> Trained:
    """Clean, derive features, drop flat and correlated ones, select by a forest's importances, fit, evaluate, save to path.

    What is dropped and selected is decided on the training table alone and applied to both. Of a
    pair correlated above the limit the later column goes; negative correlations are reported only. If
    no feature is important enough, all that are left are used.
    """
    spark = train.sparkSession
    with wide_plans(spark), written(_features(train, label, labels, remove)) as rows:
        names = [f.name for f in rows.schema if isinstance(f.dataType, T.NumericType)]
        flat, pairs = analyze.analyse(rows, names, variance)
        out = analyze.correlated_to_drop([tuple(r) for r in pairs.collect()], names, above)
        kept = [c for c in names if c not in {*flat, *out}]
        selector, classes = forest.fit_forest(rows, kept, label, n_estimators=trees, max_depth=depth, seed=seed, written=True)
        importances = cut(forest.named_importance(forest.forest_importance(forest.node_table(spark, selector)), kept))
        found = {r.feature_name for r in importances.where(F.col("importance") >= least_importance).collect()}
        selected = [c for c in kept if c in found] or kept  # no feature is that important: all stay
        model, classes = forest.fit_forest(rows, selected, label, n_estimators=trees, max_depth=depth, seed=seed, written=True)
        forest.save_forest(spark, path, model, selected, classes)
        held = forest.score(model, _features(test, label, labels, remove), selected, classes)
        predictions = cut(held.select(F.col(f"`{label}`").alias("label"), "label_predicted"))
        missing = cut(null_counts(infinite_to_null(train)))
    return Trained(
        missing, flat, pairs.where(F.abs("r") > above), out, importances, selected, classes, predictions,
        evaluate.class_report(predictions, "label", "label_predicted"), evaluate.confusion(predictions, "label", "label_predicted", classes),
    )


def _features(flows: DataFrame, label: str, labels: Sequence[str], remove: Sequence[str]) -> DataFrame:
    """Cleaned flows with derived features; the label, which is text, isn't coerced."""
    kept = clean_flows(flows, label, labels, remove).withColumn(label, F.struct(F.col(f"`{label}`").alias("text")))
    return engineer(kept).withColumn(label, F.col(f"`{label}`.text"))


def detect_flows(spark: SparkSession, landing: str, schema: T.StructType | None, model: str, sink: str, checkpoint: str, *, labels: Sequence[str] = LABELS, remove: Sequence[str] = REMOVE, period: str | None = None, finished: str | None = None) -> StreamingQuery:
    """Label counts of each flow file that lands in a folder, by the saved model.

    A file's columns are found by its header, in any order. schema None: all of them, with types found
    from the file; else those of the schema, and a file that lacks one is an error. Rows with a null in
    any of these columns and repeated rows are dropped while Label is still among them.
    """
    predict, classes = model_predictor(spark, model)
    return detect_files(stream_files(spark, landing, finished=finished), schema, predict, list(dict.fromkeys([*labels, *classes])), sink, checkpoint, remove=remove, period=period)
