"""Sum-of-squares online packing of token sequences into fixed windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import small_batches
from .tokens import default_path, worker_encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Windows of one stream of pieces; a piece is [row, start, length].

    levels[h] counts the open windows filled to h. A piece goes to the level that makes the sum of
    the squared counts least (Csirik and others, 2006); equal choices take the fullest window.
    At the end the contents of the emptiest windows are cut to fill the gaps of the fullest, so that
    one window stays partly filled. Beyond max_open windows the fullest one alone is filled so, which
    bounds memory; the other windows and their levels stay as they are.
    """

    def __init__(self, size: int, max_open: int = 4096):
        self.size, self.max_open, self.n_open = size, max_open, 0
        self.levels = np.zeros(size + 1)
        self.levels[size] = -0.5  # a window that closes leaves the sum
        self.windows: dict[int, list[list]] = {}

    def place(self, piece: list) -> list[list]:
        """Windows that this fills."""
        n, size, levels = piece[2], self.size, self.levels
        if n == size:
            return [[piece]]
        have = levels[1 : size - n + 1]
        change = np.where(have > 0, levels[n + 1 : size + 1] - have, np.inf)
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1
        if best < 0 or change[best] >= levels[n] - 0.5:
            level, window = 0, []
            self.n_open += 1
        else:
            level = best + 1
            window = self._take(level)
            self.n_open += 1
        window.append(piece)
        if level + n == size:
            self.n_open -= 1
            return [window]
        levels[level + n] += 1
        self.windows.setdefault(level + n, []).append(window)
        return [w for _ in range(self.n_open - self.max_open) for w in self.settle()]

    def _take(self, level: int) -> list:
        window = self.windows[level].pop()
        if not self.windows[level]:
            del self.windows[level]
        self.levels[level] -= 1
        self.n_open -= 1
        return window

    def settle(self) -> list[list]:
        """The fullest open window, its gap filled by cutting pieces off the emptiest ones; if they can't fill it, all there is."""
        top = max(self.windows)
        window, gap = self._take(top), self.size - top
        while gap and self.windows:
            level = min(self.windows)
            other = self._take(level)
            while gap and other:
                row, start, n = other.pop()
                if n > gap:
                    other.append([row, start + gap, n - gap])
                    n = gap
                window.append([row, start, n])
                gap -= n
                level -= n
            if other:
                self.windows.setdefault(level, []).append(other)
                self.levels[level] += 1
                self.n_open += 1
        return [window]

    def close(self) -> list[list]:
        """All open windows, settled one after another: at most one stays partly filled."""
        full = []
        while self.windows:
            full += self.settle()
        return full


def pack(docs: DataFrame, *, tokenizer: str | None = None, joins_space: bool = False, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens; one row for each piece.

    Each partition of the input is a stream of its own with its level array: no shuffle, bounded
    memory, one partly filled sequence for each partition. A document's ids end with end_id; of a
    longer document, whole windows are cut off first. A null or empty text is the end id alone. A
    null doc_id stays null; repeated rows are packed each. Only doc_id and text are read. Empty in,
    empty out. ids holds the piece's ids, little-endian unsigned 32-bit.
    """
    path = tokenizer or default_path("word_bpe_49k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, stream = worker_encoder(path, joins_space), SumOfSquares(window)
        end, sequence = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 33
        held: dict[int, list] = {}  # row: id, its ids, tokens still open
        rows: list[tuple] = []
        n_row = 0

        def emit(filled: list[list]) -> None:
            nonlocal sequence
            for pieces in filled:
                at = 0
                for row, start, n in pieces:
                    doc = held[row]
                    rows.append((doc[0], start, n, doc[1][4 * start : 4 * (start + n)], len(doc[1]) // 4, sequence, at))
                    at += n
                    doc[2] -= n
                    if not doc[2]:
                        del held[row]
                sequence += 1

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema.types, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1)), strict=True):
                    ids += end
                    n = len(ids) // 4
                    held[n_row] = [doc_id, ids, n]
                    for start in range(0, n, window):
                        emit(stream.place([n_row, start, min(window, n - start)]))
                    n_row += 1
                if sum(len(r[3]) for r in rows) > 1 << 22:
                    yield flush()
        emit(stream.close())
        yield flush()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
