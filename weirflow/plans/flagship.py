"""The library's flagship: flows to predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import safe_ratio
from ..operators.clean import drop_any_null, infinite_to_null
from ..operators.evaluate import label_counts
from ..operators.forest import fit_forest, score
from ..storage import cut

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "tax_ratio"]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*FEATURES[:4], "l_returnflag")
    return drop_any_null(infinite_to_null(rows)).dropDuplicates().withColumn("tax_ratio", safe_ratio(F.col("l_tax"), F.col("l_discount")))


def flagship(spark: SparkSession, sf_dir: str, trees: int = 10, depth: int = 5) -> DataFrame:
    rows = cut(flows(spark, sf_dir))
    model, classes = fit_forest(rows, FEATURES, "l_returnflag", n_estimators=trees, max_depth=depth, written=True)
    predicted = score(model, rows, FEATURES, classes)
    return label_counts(predicted.select(F.col("label_predicted").alias("label")), "label", [*classes, "unknown"])
