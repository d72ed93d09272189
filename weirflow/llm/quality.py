"""Quality by random Fourier features: an approximate Gaussian-kernel ridge over document statistics.

Partitions sum their normal equations, the driver solves a system whose size is the number of
features, and an isotonic fit on rows that the ridge hasn't seen turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .session import cut, small_batches
from .textbytes import Words, chunks, strings

_B = np.arange(256)
_CLASSES = [
    (_B >= 65) & (_B <= 90),  # capitals
    (_B >= 97) & (_B <= 122),
    (_B >= 48) & (_B <= 57),
    (_B == 32) | (_B == 9),
    (_B == 10),
    np.isin(_B, [ord(c) for c in ".,;:'\"-"]),
    np.isin(_B, [ord(c) for c in "!?"]),
    np.isin(_B, [ord(c) for c in "#$%&*@^~+=|<>{}[]\\/_`"]),
    _B >= 128,
    _B == ord("|"),
]
_WEIGH = np.stack(_CLASSES).astype(np.float64)
N_STATS = 22


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of N_STATS numbers for each whole text; all of them are 0 for an empty one."""
    out = np.zeros((len(texts), N_STATS))
    for at, end, data, offsets in chunks(texts):
        n = end - at
        size = np.diff(offsets)
        text_of_byte = np.repeat(np.arange(n), size)
        counts = np.bincount(text_of_byte * 256 + data, minlength=n * 256).reshape(n, 256)
        shares = counts @ _WEIGH.T / np.maximum(size, 1)[:, None]
        words = Words(data, offsets)
        hashes, n_words = words.hashes(), np.diff(words.first)
        text_of = np.repeat(np.arange(n), n_words)
        some, safe = np.maximum(n_words, 1), lambda x: x / np.maximum(n_words, 1)
        lengths = words.ends - words.starts
        mean = safe(np.bincount(text_of, lengths, n))
        spread = np.sqrt(np.maximum(safe(np.bincount(text_of, lengths.astype(float) ** 2, n)) - mean**2, 0))
        # shares of words that differ, that repeat the one before, that end in a mark, that are all capitals
        order = np.lexsort((hashes, text_of))
        h, t = hashes[order], text_of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        differ = np.bincount(t[new], minlength=n)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
        after = np.full(len(hashes), 32, np.uint8)
        inside = words.ends < len(data)
        after[inside] = data[words.ends[inside]]
        capitals = np.concatenate(([0], np.cumsum(_CLASSES[0][data])))
        loud = (capitals[words.ends] - capitals[words.starts] == lengths) & (lengths > 1) if len(lengths) else same
        odd = np.isin(after, [ord(c) for c in "!#$%&*|"])
        two = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1]
        pair_of = text_of[1:]
        within = pair_of == text_of[:-1]
        order = np.lexsort((two[within], pair_of[within]))
        h, t = two[within][order], pair_of[within][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        pairs_differ = np.bincount(t[new], minlength=n) / np.maximum(n_words - 1, 1)
        lines = counts[:, 10] + 1
        stats = [np.log1p(size), np.log1p(n_words), mean, spread, differ / some, pairs_differ, safe(np.bincount(text_of[same], minlength=n)), safe(np.bincount(text_of[loud], minlength=n)), safe(np.bincount(text_of[odd], minlength=n)), np.log1p(n_words / lines), np.sqrt(safe(np.bincount(text_of[odd], minlength=n))), np.sqrt(safe(np.bincount(text_of[loud], minlength=n)))]
        stats = np.column_stack([*stats, shares])
        stats[size == 0] = 0
        out[at:end] = stats
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """sqrt(2/D) cos(x W + b), and 1 for the intercept."""
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.omega + self.phase)
        return np.column_stack([z, np.ones(len(z))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), self.levels[0])
        raw = self.features(stats) @ self.weights
        # within a level a little of the ridge's order is kept
        return np.clip(0.98 * np.interp(raw, self.knots, self.levels) + 0.02 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots at the ends of the pools, each level pulled towards 1/2 by one row."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, c, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += c
            pools[-1][3] = last
    knots, levels = [], []
    for s, c, first, last in pools:
        knots += [first, last]
        levels += [(s + 0.5) / (c + 1)] * 2
    return np.array(knots), np.maximum.accumulate(np.array(levels))


def _sums(rows: DataFrame, model: Model, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over rows (y, stats): a matrix from each of at most `parts` partitions."""
    d = model.omega.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            z = model.features(np.array(batch.column(1).to_pylist(), float).reshape(-1, N_STATS))
            gram += z.T @ z
            right += z.T @ np.array(batch.column(0).to_pylist(), float)
        yield pa.record_batch([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["gram", "right"])

    found = rows.select("y", "stats").coalesce(parts).mapInArrow(run, "gram binary, right binary").toArrow()
    gram = sum((np.frombuffer(x.as_py()).reshape(d, d) for x in found["gram"]), np.zeros((d, d)))
    return gram, sum((np.frombuffer(x.as_py()) for x in found["right"]), np.zeros(d))


def train(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, remainder: int = 2, rows: int = 20000, dimensions: int = 192, ridge: float = 0.02, width: float = 3.0, parts: int = 16) -> Model:
    """Fit on at most `rows` labelled documents whose crc32(doc_id) mod modulus isn't remainder.

    Two thirds of them (by a hash of the id) give the ridge, one third the isotonic levels. Only
    statistics leave the executors: `parts` matrices, and the statistics of the last third. Null
    and empty texts have statistics of 0. Null ids and null labels are left out; of repeated ids one
    text counts, of conflicting labels 1. With fewer than 20 rows, or with one label only, every text
    gets the share of label 1. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(statistics(strings(batch.column(2))).tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "stats"])

    taken = sample(docs, labels, "quality", held_out(F.col("doc_id"), modulus, remainder), rows)
    known = cut(taken.select(F.col("doc_id").cast("long"), "y", "text").mapInArrow(run, "doc_id long, y double, stats array<double>"))
    known = known.withColumn("third", F.pmod(F.xxhash64(F.lit("third"), "doc_id"), F.lit(3)))
    moments = known.agg(F.count(F.lit(1)), F.avg("y"), *[f(F.col("stats")[i]) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    n, share = moments[0], moments[1]
    rng = np.random.default_rng(7)
    omega = rng.normal(size=(N_STATS, dimensions)) / width
    phase = rng.uniform(0, 2 * np.pi, dimensions)
    none = np.zeros(0)
    if n < 20 or share in (0.0, 1.0):
        return Model(np.zeros(N_STATS), np.ones(N_STATS), omega, phase, none, none, np.array([0.5 if share is None else (share * n + 0.5) / (n + 1)]))
    mean, scale = np.array(moments[2::2], float), np.array(moments[3::2], float)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), omega, phase, none, none, none)
    gram, right = _sums(known.where("third > 0"), model, parts)
    penalty = np.eye(len(gram)) * ridge
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(gram + penalty + 1e-9 * np.eye(len(gram)), right)
    rest = known.where("third = 0").select("doc_id", "y", "stats").toArrow()
    x = model.features(np.array(rest["stats"].to_pylist(), float).reshape(-1, N_STATS)) @ model.weights
    ids, y = np.array(rest["doc_id"].to_pylist(), np.int64), np.array(rest["y"].to_pylist(), float)
    order = np.lexsort((ids, x))
    model.knots, model.levels = isotonic(x[order], y[order])
    if not len(model.knots):
        model.levels = np.array([share])
    return model


def score(docs: DataFrame, model: Model, *, modulus: int = 4, remainder: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, in one scan.

    Null and empty texts are scored by statistics of 0. Null ids aren't held out. Repeated rows are
    scored each. labels, lang, source and doc_id aren't used. Empty in, empty out.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(model.score(statistics(strings(batch.column(1)))))], names=["doc_id", "held_out", "score"])

    fold = held_out(F.col("doc_id"), modulus, remainder).alias("held_out")
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), fold).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
