"""Sharding along a Hilbert curve over quantised metadata, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import cut, fresh, lookup


def hilbert_index(coordinates: Sequence[Column], bits: int) -> Column:
    """Index along the curve of a cell; coordinates are ints in [0, 2**bits).

    Skilling's transform: one step for each (bit, axis), folded over a literal list, so that the
    expression has the same size for any number of bits.
    """
    n = len(coordinates)
    if n < 2 or n * bits > 62:
        raise ValueError("2 dimensions or more, 62 bits at most")
    steps = [(1 << b, axis) for b in range(bits - 1, 0, -1) for axis in range(n)]
    x = F.array(*[c.cast("int") for c in coordinates])

    def step(state: Column, s: Column) -> Column:
        q, axis = s["q"], s["axis"]
        low = q - F.lit(1)
        head, own = F.element_at(state, 1), F.element_at(state, axis + F.lit(1))
        high = own.bitwiseAND(q) != 0
        swap = head.bitwiseXOR(own).bitwiseAND(low)
        new_head = F.when(high, head.bitwiseXOR(low)).otherwise(head.bitwiseXOR(swap))
        new_own = F.when(high | (axis == 0), own).otherwise(own.bitwiseXOR(swap))
        new_head = F.when((axis == 0) & ~high, head).otherwise(new_head)
        return F.transform(state, lambda v, i: F.when(i == 0, new_head).when(i == axis, new_own).otherwise(v))

    if steps:
        x = F.aggregate(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(a).alias("axis")) for q, a in steps]), x, step)
    # each step binds its input once: F.transform over a list of one
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    # Gray code along the axes, then the parity correction from the last axis
    gray = let(x, lambda s: F.transform(s, lambda v, i: F.aggregate(F.slice(s, 1, i + F.lit(1)), F.lit(0), lambda a, b: a.bitwiseXOR(b))))
    qs = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]).cast("array<int>")
    fix = lambda s: F.aggregate(qs, F.lit(0), lambda t, q: F.when(F.element_at(s, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - F.lit(1))).otherwise(t))
    axes = let(gray, lambda s: let(fix(s), lambda f: F.transform(s, lambda v: v.bitwiseXOR(f).cast("long"))))
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a + 1).alias("a")) for b in range(bits - 1, -1, -1) for a in range(n)])

    def place(s: Column, index: Column, p: Column) -> Column:
        bit = F.call_function("shiftright", F.element_at(s, p["a"]), p["b"]).bitwiseAND(F.lit(1).cast("long"))
        return F.call_function("shiftleft", index, F.lit(1)).bitwiseOR(bit)

    return let(axes, lambda s: F.aggregate(places, F.lit(0).cast("long"), lambda index, p: place(s, index, p)))


def quantised(docs: DataFrame, bits: int) -> list[Column]:
    """Metadata of a document as cells: language, source, and the logarithm of its size.

    Strings take the cell of their hash (equal values share a cell at any size of the table);
    null is a value of its own.
    """
    cells = 1 << bits
    name = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0null"))), F.lit(cells)).cast("int")
    size = F.floor(F.log2(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + F.lit(1.0)) * F.lit(cells / 32)).cast("int")
    return [name("lang"), name("source"), F.least(size, F.lit(cells - 1))]


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard, slot for each row; runs of the curve of equal row counts.

    Law `rows`: the counts of shards differ by one at most. Size is the UTF-8 bytes of the text
    plus 1; a null text has none. Texts are equal when their size, crc and 64-bit hash are. All rows of
    a text take the least curve index among them, whatever their language and source, and lie next to
    each other: a group of copies is cut only where a shard ends, and a cell may hold any share of the
    table. Repeated rows each get a slot. Null metadata is a value of its own; missing columns raise.
    Empty in, empty out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang, source, size = quantised(docs, bits)
    slim = cut(docs.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"), hilbert_index([lang, source, size], bits).alias("hilbert"),
    ))
    same = ["_hash", "text_crc32", "size"]
    # a hot text comes down to a row for each task before the shuffle, and its rows are dealt over tasks after it
    least = slim.groupBy(*same).agg(F.min("hilbert").alias("_least"), F.max("hilbert").alias("_most"), F.count(F.lit(1)).alias("_times")).where("_least < _most").drop("_most")
    slim = lookup(slim, least, same, "_times", how="left", row_bytes=40).withColumn("hilbert", F.coalesce("_least", "hilbert")).drop("_least")
    order = ["hilbert", "text_crc32", "size", "_hash", "doc_id"]
    # the id's lower half is the place in the sorted partition: a global rank without a window over all rows
    placed = cut(slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    # one row for each partition
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = counts.select("_part", (F.sum("_n").over(before) - F.col("_n")).alias("_start"), F.sum("_n").over(W.partitionBy()).alias("_total"))
    rank = placed.join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_start") + F.col("_row"))
    k = F.lit(shards).cast("long")
    shard = F.expr("(_rank * %d) div _total" % shards)
    out = rank.withColumn("_shard", shard)
    first = F.expr("(_shard * _total + %d) div %d" % (shards - 1, shards))
    return out.select("doc_id", "size", "text_crc32", "hilbert", F.least(F.col("_shard"), k - 1).cast("int").alias("shard"), (F.col("_rank") - first).alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, *, files: int = 4, key: str = "doc_id", shards: int = 8) -> None:
    """The rows as a folder for each shard with `files` files, each a run of the curve in slot order.

    A file's statistics bound the metadata of its run, so that filters on several dimensions skip
    most files. key must identify a row here; a null key isn't written. Columns of any name come back
    as they are, but for `shard`, which the folders carry: if docs has such a column this raises.
    """
    if "shard" in docs.columns:
        raise ValueError("docs has a column shard")
    p = fresh(docs)
    slots = assigned.select(F.col("doc_id").alias(p + "id"), "shard", F.col("slot").alias(p + "slot"))
    placed = docs.join(slots, F.col(f"`{key}`") == F.col(p + "id")).drop(p + "id")
    placed.repartitionByRange(shards * files, "shard", p + "slot").sortWithinPartitions("shard", p + "slot").drop(p + "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
