"""Bounded, reproducible samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, fold: Column, rows: int) -> DataFrame:
    """(doc_id, y, text) of at most `rows` labelled documents outside the fold, the first by a hash of the id.

    The labels alone are ranked; the ids taken are few (their bound is `rows`) and are broadcast
    to one scan of the documents. Of conflicting labels for an id, 1 counts; of repeated ids, the
    text with the smallest hash. Null ids and labels are left out; a null text counts as empty.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~fold)
    known = known.groupBy("doc_id").agg(F.max(target).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    taken = known.select(F.col("doc_id"), F.col("y").cast("double"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(taken), "doc_id")
    return found.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
