"""How filters interact: what each removes in every order, from counts of failure masks.

A document's mask says which of the filters it fails. For one part of the corpus the number of
documents that a set of filters removes is a function of that set; its multilinear extension, the
removal polynomial, has one coefficient for each set. Its corners are the removals of sets, and the
integral of a partial derivative along the diagonal is a filter's Shapley value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, lookup, remove, small_batches, table_path

LETTERS = "ABCDE"
UPPER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bit of the filter that a copy of another document fails.
COPY = 1 << LETTERS.index("E")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_mask(text: str) -> int:
    """Bits of the failures A to D, which need the text alone; words are runs without ASCII white space."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    short, few = len(words) < 50, 100 * len(set(words)) < 65 * len(words)
    upper = 100 * (len(data) - len(data.translate(None, UPPER))) > 5 * len(text)
    return short | few << 1 | upper << 2 | (len(data.translate(None, MARKS)) < len(data)) << 3


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or "" for t in b.column(2).to_pylist()]
        masks = pa.array(map(own_mask, texts), pa.int32())
        digests = pa.array((hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), masks, digests], ["doc_id", "part", "mask", "digest"])


def masks(docs: DataFrame, path: str, part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every row of docs; what the texts alone say is written to path, which is read until the result is.

    Texts are the same when their SHA-256 is. A copy is a row with a larger id than another row of
    the same text: rows that repeat an id don't make each other copies, and a null id is never
    larger nor smaller than any. Null texts are empty, null parts are the empty string.
    """
    small_batches(docs.sparkSession)
    text = docs.select("doc_id", F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    text.mapInArrow(_masked, f"doc_id {kind}, part string, mask int, digest binary").write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    # a text that many documents share is one row here, and its documents are dealt over tasks
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    found = lookup(rows, firsts, ["digest"], "times", how="left", row_bytes=48)
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return found.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, COPY).otherwise(0)).alias("mask"))


def mask_counts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask, and how many of them `labels` marks as good or toxic.

    Of repeated labels of an id 1 counts; labels without an id, and documents without a label, are
    neither. A part has 32 rows at most, whatever its documents.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    marked = found.join(known, "doc_id", "left")
    return marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


class Removal:
    """The removal polynomial of a part: sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)), multiplied out.

    A set of filters is a number whose bits are its members; `coefficients` has one for each set.
    """

    def __init__(self, counts: Mapping[int, int], filters: int):
        self.filters = filters
        # of all masks that hold a set
        above = [counts.get(s, 0) for s in range(1 << filters)]
        for i in range(filters):
            for s in range(1 << filters):
                if not s >> i & 1:
                    above[s] += above[s | 1 << i]
        self.coefficients = [0, *(n if s.bit_count() % 2 else -n for s, n in enumerate(above) if s)]

    def corner(self, chosen: int) -> int:
        """The polynomial where x is 1 for the chosen filters and 0 for others: how many they remove together."""
        return sum(c for s, c in enumerate(self.coefficients) if s | chosen == chosen)

    def slope(self, i: int) -> list[int]:
        """The partial derivative by x_i on the diagonal x = (t, ..., t): its coefficients by the power of t."""
        powers = [0] * self.filters
        for s, c in enumerate(self.coefficients):
            if s >> i & 1:
                powers[s.bit_count() - 1] += c
        return powers

    def shapley(self, i: int) -> Fraction:
        """The filter's removals over a random order: the slope's integral from 0 to 1."""
        return sum((Fraction(c, k + 1) for k, c in enumerate(self.slope(i))), Fraction(0))


def interactions(counts: Mapping[int, tuple[int, int, int]], letters: str = LETTERS) -> Iterator[tuple]:
    """(filter_order, step, *COUNTS) of all orders, from a part's (documents, good, toxic) of each mask."""
    k = len(letters)
    every, good, toxic = (Removal({m: c[j] for m, c in counts.items()}, k) for j in range(3))
    total, orders, all_ = sum(c[0] for c in counts.values()), factorial(k), (1 << k) - 1
    corners = [[p.corner(s) for s in range(1 << k)] for p in (every, good, toxic)]
    shapley = [every.shapley(i) * orders for i in range(k)]
    if any(x.denominator != 1 for x in shapley):
        raise ArithmeticError("the orders' sums are whole numbers")
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            after, own = before | 1 << i, 1 << i
            gone, lost_good, lost_toxic = (c[after] - c[before] for c in corners)
            unique = corners[0][all_] - corners[0][all_ ^ own]
            yield "".join(letters[j] for j in order), step, total - corners[0][after], gone, corners[0][own] - gone, unique, lost_good, lost_toxic, int(shapley[i])
            before = after


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step of mask_counts(): part, filter_order, step and COUNTS; a part has 600 rows."""

    def of_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = {m: (n, g, t) for m, n, g, t in rows[["mask", "n", "good", "toxic"]].itertuples(index=False)}
        out = pd.DataFrame(interactions(found), columns=["filter_order", "step", *COUNTS])
        out.insert(0, "part", key[0])
        return out

    return counts.groupBy("part").applyInPandas(of_part, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """audit() of documents: filters A (under 50 words), B (under 65 % distinct words), C (over 5 % capitals), D (a mark of #$%&*|), E (a copy of a smaller id's text).

    Empty in, empty out; null texts, ids and parts, repeated rows and other columns: see masks().
    The table of masks is removed once the counts, 32 rows a part, are in the shared folder.
    """
    path = table_path(docs.sparkSession, "masks")
    found = masks(docs.select("doc_id", "text", part_col), path, part_col)
    counts = cut(mask_counts(found, labels))
    remove(docs.sparkSession, path)
    return audit(counts)
