"""Token files with fixed-width bit packing and block offsets.

A file set is a Parquet table (Spark's writer commits it, so it lives in any store and survives
lost executors) whose rows are self-contained binary segments in ascending doc_id order:

    4s magic, u8 version, u8 bits of an id, u16 0, u32 ids in a block, u32 blocks, u64 ids, u32 documents, u32 0
    u64 byte offset of each block and of the end, from the first block on
    u64 first id of each document and the end; i64 doc_id of each document; u8 whether it is null
    blocks: ids one after another, low bit first, each block from a whole byte on
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import small_batches
from .tokens import default_path, vocabulary_size, worker_encoder

HEAD = struct.Struct("<4sBBHIIQII")
MAGIC, VERSION = b"WFBP", 1
SEGMENT_IDS = 1 << 18
#: Parquet's reader holds a row group's rows at once (up to thousands), so groups are kept to a few megabytes.
ROW_GROUPS = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 2, "parquet.block.size.row.check.max": 2, "parquet.page.size.row.check.min": 2}


def width_for(vocabulary: int) -> int:
    """Least bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype("<u4")


def write_segment(doc_ids: list[int | None], documents: list[bytes], bits: int, block_ids: int = 4096) -> bytes:
    """documents: little-endian unsigned 32-bit ids."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    if bits < 32 and len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    starts = np.concatenate(([0], np.cumsum([len(d) // 4 for d in documents]))).astype("<u8")
    blocks = [pack_bits(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    head = HEAD.pack(MAGIC, VERSION, bits, 0, block_ids, len(blocks), len(ids), len(documents), 0)
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    return b"".join([head, offsets.tobytes(), starts.tobytes(), names, *blocks])


class Segment:
    """Random access to a segment: only the blocks that a slice touches are unpacked."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        magic, version, self.bits, _, self.block_ids, n_blocks, self.n_ids, self.n_docs, _ = HEAD.unpack_from(self.data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment")
        at = HEAD.size
        self.offsets = np.frombuffer(self.data, "<u8", n_blocks + 1, at)
        at += 8 * (n_blocks + 1)
        self.starts = np.frombuffer(self.data, "<u8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        names = np.frombuffer(self.data, "<i8", self.n_docs, at).tolist()
        at += 8 * self.n_docs
        self.doc_ids = [None if null else d for d, null in zip(names, bytes(self.data[at : at + self.n_docs]), strict=True)]
        self.body = at + self.n_docs

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        parts = []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            parts.append(unpack_bits(self.data[self.body + int(self.offsets[b]) : self.body + int(self.offsets[b + 1])], self.bits, n))
        return np.concatenate(parts)[start - first * self.block_ids : stop - first * self.block_ids]


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, joins_space: bool = True, vocabulary: int | None = None, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode all documents and write their ids in ascending doc_id order.

    Null ids come first; repeated ids go by a hash of their texts. A null or empty text is the end
    id alone. A document lies in one segment whole. Only doc_id and text are read. vocabulary: the
    number of ids, the tokenizer's own unless it is given.
    """
    file = tokenizer or default_path("byte_bpe_50k.json")
    bits = width_for(vocabulary or vocabulary_size(file))
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, shard, end = worker_encoder(file, joins_space), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        names: list[int | None] = []
        held: list[bytes] = []
        size = before = segment = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, before, segment
            out = pa.record_batch([pa.array([x], t) for x, t in zip((shard, segment, before, size, len(names), next((d for d in names if d is not None), None), names[-1], write_segment(names, held, bits)), schema.types, strict=True)], schema=schema)
            before, size, segment = before + size, 0, segment + 1
            names.clear()
            held.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1)), strict=True):
                    names.append(doc_id)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= segment_ids:
                        yield flush()
        if names:
            yield flush()

    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("_tie", F.xxhash64("text"))
    ordered = plain.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    ordered.mapInArrow(run, "shard int, segment int, ids_before long, n_ids long, n_docs long, first_doc long, last_doc long, data binary").write.options(**ROW_GROUPS).mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit) from the files.

    A null doc_id comes back as null, a repeated one as often as it was written; a null or empty text
    is its end id. An empty table gives no rows.
    """
    table = spark.read.parquet(path)
    # one row for each shard, that is each partition of the writer
    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    starts = shards.select("shard", (F.sum("_n").over(W.orderBy("shard")) - F.col("_n")).alias("_start"))
    placed = table.join(F.broadcast(starts), "shard").select((F.col("_start") + F.col("ids_before")).alias("start"), "data")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(data.as_buffer())
                at = s.starts.astype(np.int64)
                # views of a buffer given to pa.array would never be freed
                ids = pa.Array.from_buffers(pa.binary(), s.n_docs, [None, pa.py_buffer((4 * at).astype("<i4")), pa.py_buffer(s.ids())])
                yield pa.record_batch([pa.array(s.doc_ids, pa.int64()), pa.array(start + at[:-1]), pa.array(np.diff(at)), ids], schema=schema)

    small_batches(spark)
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _ranges(ids: Sequence[int], most: int) -> list[tuple[int, int]]:
    """At most so many ranges that hold these rising ids, cut at the widest gaps."""
    widest = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: most - 1]
    cuts = [0, *sorted(widest), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]


def fetch_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """doc_id, n_tokens, ids of these documents only: the segments whose range holds one are read, and of them the blocks that it touches.

    The statistics of first_doc and last_doc let Parquet skip other row groups; of many ids those
    between the ids' widest gaps are read. An id that stands several times has a row for each; one
    that isn't there has none.
    """
    wanted = frozenset(doc_ids)
    if not wanted:
        return spark.createDataFrame([], "doc_id long, n_tokens long, ids binary")
    near = reduce(or_, [(F.col("first_doc") <= b) & (F.col("last_doc") >= a) for a, b in _ranges(sorted(wanted), 100)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for data in batch.column(0):
                s = Segment(data.as_buffer())
                for i, d in enumerate(s.doc_ids):
                    if d in wanted:
                        rows.append((d, int(s.starts[i + 1] - s.starts[i]), s.ids(int(s.starts[i]), int(s.starts[i + 1])).tobytes()))
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_tokens", "ids"])

    return spark.read.parquet(path).where(near).select("data").mapInArrow(run, "doc_id long, n_tokens long, ids binary")
