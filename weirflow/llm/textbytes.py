"""Words of many texts at once, with numpy on their UTF-8 bytes.

A word is a run of ASCII letters, digits and non-ASCII characters; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_B = np.arange(256)
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
IS_WORD = ((LOWER >= 97) & (LOWER <= 122)) | ((_B >= 48) & (_B <= 57)) | (_B >= 128)
_RNG = np.random.default_rng(20240607)
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER] | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one plain string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts with about `limit` bytes."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Starts, ends and hashes of the words of a run of texts; first[i]:first[i+1] are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = IS_WORD[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        if len(inside):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[offsets[:-1][offsets[:-1] < len(inside)]] = False
            ends = offsets[1:] - 1
            after[ends[ends >= 0]] = False
        self.data, self.inside = data, inside
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """Of the whole words, or of their first `prefix` bytes."""
        sizes = self.ends - self.starts
        if not len(sizes):
            return np.zeros(0, np.uint64)
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
        if prefix is not None:
            head, sizes = place < prefix, np.minimum(sizes, prefix)
            at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            return mix(np.add.reduceat(_LETTER[self.data[self.inside][head]] * np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(prefix - 1, _BASE))))[place[head]], at) + np.uint64(1 << 40))
        powers = np.ones(int(sizes.max()), np.uint64)
        powers[1:] = _BASE
        powers = np.multiply.accumulate(powers)
        return mix(np.add.reduceat(_LETTER[self.data[self.inside]] * powers[place], at) + sizes.astype(np.uint64))


_TURN = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words of one text; a shorter text is one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < k:
        total = np.array([n], np.uint64)
        for j in range(n):
            total = mix(total * _BASE + hashes[j : j + 1])
        return total
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += hashes[j : n - k + 1 + j] * _TURN[j % 5]
    return mix(out)


def labelled(sequence: np.ndarray) -> np.ndarray:
    """Each element together with the number of its occurrence so far: all results differ."""
    order = np.argsort(sequence, kind="stable")
    ranked = sequence[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return sequence
    run = np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
    times = np.empty(len(ranked), np.uint64)
    times[order] = (np.arange(len(ranked)) - run).astype(np.uint64)
    return np.where(times > 0, mix(sequence + times * _BASE), sequence)
