"""Confusion matrix and classification report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """A row for each label that is true or predicted anywhere, a column pred_<class> for each class: counts, zero where there are none."""
    pairs = df.groupBy(F.col(label).alias("_y"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    own, other = F.struct("_y", "_p", "_n"), F.struct(F.col("_p").alias("_y"), F.col("_p"), F.lit(0).cast("long").alias("_n"))
    sides = pairs.select(F.inline(F.array(own, other)))
    count = lambda c: F.coalesce(F.sum(F.when(F.col("_p") == c, F.col("_n"))), F.lit(0).cast("long"))
    return sides.groupBy(F.col("_y").alias(label)).agg(*[count(c).alias(f"pred_{c}") for c in classes])


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support; then accuracy, macro avg and weighted avg. Zero divisions give 0."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).alias("called"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).alias("support"), F.col("n").alias("called"), F.lit(0).alias("hit")))).alias("s"))
    sums = sides.groupBy("s.c").agg(F.sum("s.support").alias("support"), F.sum("s.called").alias("called"), F.sum("s.hit").alias("hit"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    each = sums.select(F.col("c").alias("class"), share("hit", "called").alias("precision"), share("hit", "support").alias("recall"), "support", "hit")
    each = each.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    scores = ["precision", "recall", "f1"]
    total = F.sum("support")
    accuracy = F.try_divide(F.sum("hit").cast("double"), total)
    rows = [each.select("class", *scores, "support")]
    rows.append(each.agg(*[accuracy.alias(s) for s in scores], total.alias("support")).select(F.lit("accuracy").alias("class"), *scores, "support"))
    rows.append(each.agg(*[F.avg(s).alias(s) for s in scores], total.alias("support")).select(F.lit("macro avg").alias("class"), *scores, "support"))
    rows.append(each.agg(*[F.try_divide(F.sum(F.col(s) * F.col("support")), total).alias(s) for s in scores], total.alias("support")).select(F.lit("weighted avg").alias("class"), *scores, "support"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def label_counts(df: DataFrame, label: str, dimension: Sequence[str]) -> DataFrame:
    """Counts of all labels of the dimension, zero where absent; labels outside it keep a row too. One aggregate, no join."""
    zeros = df.sparkSession.createDataFrame([(c, 0) for c in dimension], "label string, n long")
    ones = df.select(F.col(label).alias("label"), F.lit(1).cast("long").alias("n"))
    return ones.unionAll(zeros).groupBy(F.col("label").alias(label)).agg(F.sum("n").alias("n"))
