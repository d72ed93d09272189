"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters deal the rows out by ranges of the normalised bytes (their beginning, and a hash
that tells texts with one beginning apart); the external sort puts equal texts next to each other in
the order of their ids, and the window compares each sorted row with its neighbour by all bytes of
the text. A group of copies that the sample shows to be large is split between ranges of its ids:
its runs end at a border of these, and only such runs, one short row for each, are merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import cut, fresh, small

#: Rows sampled for each partition of a shuffle, those of them that make a group hot, and those between two splitters of its ids.
SAMPLED, HOT, BETWEEN = 100, 50, 25

#: Place of `_id` among the sorted splitters `_bounds`, by bisection.
_PLACE = """aggregate(sequence(1, 1 + CAST(ceil(log2(size(_bounds) + 1)) AS INT)), named_struct('lo', 0, 'hi', size(_bounds)), (s, x) ->
  IF(s.lo >= s.hi, s, IF(coalesce(_bounds[shiftright(s.lo + s.hi, 1)] < _id, false), named_struct('lo', shiftright(s.lo + s.hi, 1) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', shiftright(s.lo + s.hi, 1)))), s -> s.lo)"""


def _hot_groups(rows: DataFrame) -> DataFrame:
    """(_hash, _bounds): splitters of the ids of texts that fill half a partition's share of the sample or more.

    The sample has about SAMPLED rows for each partition, which bounds this table: it grows with the
    number of partitions, as the splitters of a range partitioning do.
    """
    spark = rows.sparkSession
    wanted = SAMPLED * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    sampled = rows.sample(wanted / n, 7) if n > wanted else rows
    groups = sampled.select("_id", F.xxhash64("_text").alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list("_id")).alias("_ids"))
    return cut(groups.where(F.col("_n") >= HOT).select("_hash", F.expr(f"filter(_ids, (x, i) -> i % {BETWEEN} = {BETWEEN - 1})").alias("_bounds")))


def content_sort_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, splitter_bytes: int = 64) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of equal texts stays. A null text counts as empty and equals
    other empty texts. Null ids rank behind all others; a group of null ids has a null keep_id.
    Of repeated rows (same id, same text) exactly one is kept; they and null ids aren't split
    between ranges. Other columns are not looked at. An empty table gives an empty result.
    splitter_bytes bounds what a splitter holds, not what is compared: texts that agree so far are
    told apart by a hash and then by all their bytes.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep!r}")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("_id"), (normalise(text) if normalise else text).alias("_text"))
    hot = _hot_groups(rows)
    rows = rows.select("_id", "_text", F.substring(F.col("_text").cast("binary"), 1, splitter_bytes).alias("_head"), F.xxhash64("_text").alias("_hash"))
    # few: bounded by the sample
    rows = rows.join(F.broadcast(hot), "_hash", "left").select("_id", "_text", "_head", "_hash", F.when(F.col("_bounds").isNull(), 0).otherwise(F.lit(1) + F.expr(_PLACE)).alias("_block"))
    best = F.min if keep == "smallest" else F.max
    first = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    # the range partitioning on (_head, _hash, _block) serves the window: no second shuffle of texts;
    # the window starts a run where a sorted row's bytes differ from its neighbour's
    run = W.partitionBy("_head", "_hash", "_block", "_text")
    sorted_rows = rows.repartitionByRange("_head", "_hash", "_block").select(
        "_id",
        "_block",
        F.sha2("_text", 256).alias("text_sha256"),
        F.row_number().over(run.orderBy(first)).alias("_rank"),
        F.count(F.lit(1)).over(run).alias("_n"),
        best("_id").over(run).alias("_best"),
    )
    slim = cut(sorted_rows)
    whole = slim.where("_block = 0").select(F.col("_id").alias("doc_id"), F.col("_best").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_rank") == 1).alias("kept"), "text_sha256")
    # runs that a border between ids may have cut: one row for each, of the hot groups only
    runs = slim.where("_block > 0 AND _rank = 1").groupBy("text_sha256").agg(F.sum("_n").alias("group_size"), best("_best").alias("keep_id"))
    merged = slim.where("_block > 0").join(small(cut(runs), 150), "text_sha256")
    kept = (F.col("_rank") == 1) & F.col("_id").eqNullSafe(F.col("keep_id"))
    return whole.unionByName(merged.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def drop_marked(docs: DataFrame, decisions: DataFrame, *, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with the columns it has, without the rows that content_sort_dedup didn't keep.

    Only ids of dropped rows travel; they are broadcast if few enough. Rows are known by their id
    (null is an id too) and text (null counts as empty); of repeated rows one stays, whichever.
    Columns of any name come back as they are. Empty in, empty out.
    """
    p = fresh(docs)
    gone = decisions.where(~F.col("kept")).groupBy(F.col("doc_id").alias(p + "id"), F.col("text_sha256").alias(p + "of"))
    marks = cut(gone.agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias(p + "repeat")))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.withColumn(p + "sha", F.sha2(normalise(text) if normalise else text, 256))
    joined = keyed.join(small(marks, 150), F.col("doc_id").eqNullSafe(F.col(p + "id")) & (F.col(p + "sha") == F.col(p + "of")), "left")
    once = joined.where(F.col(p + "repeat").isNull())
    if not marks.where(p + "repeat").isEmpty():
        once = once.unionByName(joined.where(p + "repeat").dropDuplicates(["doc_id", p + "sha"]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
