"""Toxicity by multiple-instance learning: labels of documents train scores of sentences.

A document's probability is the noisy-or of its sentences', 1 - prod(1 - s); a sentence's is the
logistic of the weights of its words. Training needs no labelled sentences, and the sentences with
the largest scores tell where the offence is.
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

PREFIX = 5
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


def sentences(words: Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentence number of each word and the text of each sentence; sentences without words don't count."""
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    breaks = np.concatenate(([0], np.cumsum(_BREAK[words.data])))
    passed = breaks[words.starts] if len(words.starts) else np.zeros(0, np.int64)
    new = np.ones(len(passed), bool)
    new[1:] = (passed[1:] != passed[:-1]) | (text_of[1:] != text_of[:-1])
    return np.cumsum(new) - 1, text_of[new]


def terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and of the beginnings of longer ones, with the number of the word of each.

    Beginnings carry what inflected forms share.
    """
    whole = words.hashes()
    longer = np.flatnonzero(words.ends - words.starts > PREFIX)
    return np.concatenate([whole, words.hashes(PREFIX)[longer]]), np.concatenate([np.arange(len(whole)), longer])


@dataclass
class Model:
    """Weights of terms by their hashes, sorted; every other term weighs nothing."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def sentence_scores(self, hashes: np.ndarray, sentence_of: np.ndarray, n: int) -> np.ndarray:
        total = np.full(n, self.bias)
        if len(self.keys) and len(hashes):
            at = np.flatnonzero(self._sieve()[(hashes >> np.uint64(44)).astype(np.int64)])  # most words end here
            spot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            hit = self.keys[spot] == hashes[at]
            total += np.bincount(sentence_of[at[hit]], self.weights[spot[hit]], n)
        return total

    def _sieve(self) -> np.ndarray:
        if not hasattr(self, "_bits"):
            self._bits = np.zeros(1 << 20, bool)
            self._bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        return self._bits


def noisy_or(z: np.ndarray, text_of: np.ndarray, n: int, times: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """log(1 - p) of each text and the probability of each sentence, which stands `times` times in its text."""
    s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    return np.bincount(text_of, -np.logaddexp(0, np.clip(z, -60, 60)) * times, n), s


@dataclass
class Bags:
    """Training documents as sentences: each is a bag of terms that stands `times` times in its document."""

    terms: np.ndarray  # places of terms, sentence after sentence
    sentence_of: np.ndarray
    times: np.ndarray
    text_of: np.ndarray
    y: np.ndarray


def gradient(bags: Bags, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
    """Mean loss of the noisy-or likelihood and its slopes by the weights and the bias."""
    n = len(bags.y)
    z = bias + np.bincount(bags.sentence_of, w[bags.terms], len(bags.times))
    log_clean, s = noisy_or(z, bags.text_of, n, bags.times)
    p = np.clip(-np.expm1(log_clean), 1e-9, 1.0)
    loss = -float(np.sum(np.where(bags.y > 0.5, np.log(p), log_clean))) / n
    slope = bags.times * s * ((p - bags.y) / p)[bags.text_of] / n
    return loss, np.bincount(bags.terms, slope[bags.sentence_of], len(w)), float(slope.sum())


def fit(bags: Bags, keys: np.ndarray, *, rounds: int = 250, rate: float = 0.15, shrink: float = 2e-4) -> Model:
    """Proximal Adam on the noisy-or likelihood. keys: sorted hashes of the terms."""
    n = len(bags.y)
    prior = (float(bags.y.sum()) + 0.5) / (n + 1) if n else 0.0
    if n == 0 or bags.y.min() == bags.y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0 if prior < 0.5 else 20.0, prior)
    w, bias, m, v = np.zeros(len(keys)), -4.0, np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for t in range(1, rounds + 1):
        _, by_weight, by_bias = gradient(bags, w, bias)
        g = np.concatenate((by_weight, [by_bias]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - shrink * rate, 0)
        bias = float(np.clip(bias - step[-1], -12, 2))
    used = w != 0
    return Model(keys[used], w[used], bias, prior)


def _useful(taken: DataFrame, least_texts: int) -> np.ndarray:
    """Sorted hashes of the terms that least_texts documents hold and that positive ones hold more often; counted by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for at, _, data, offsets in chunks(strings(batch.column(2))):
                words = Words(data, offsets)
                own, word = terms(words)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))[word]
                order = np.lexsort((own, owner))
                own, owner = own[order], owner[order]
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
                yield pa.record_batch([pa.array(own[new].view(np.int64)), pa.array(y[owner[new] + at])], names=["term", "y"])

    base = taken.agg(F.avg("y")).first()[0]
    if base in (None, 0.0, 1.0):
        return np.zeros(0, np.uint64)
    held = taken.mapInArrow(run, "term long, y double").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive"))
    # words that are no likelier in positive texts can't raise a noisy-or
    found = held.where((F.col("n") >= least_texts) & (F.col("positive") > F.col("n") * min(0.5, 2 * base))).select("term").toArrow()
    return np.sort(np.array(found["term"].to_numpy()).astype(np.int64).view(np.uint64))


def _bags(taken: DataFrame, keys: np.ndarray) -> Bags:
    """The documents' sentences as bags of the terms in keys; equal sentences of a document, with none of them for example, are one bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for at, end, data, offsets in chunks(strings(batch.column(2))):
                words = Words(data, offsets)
                of, owner = sentences(words, offsets)
                own, word = terms(words)
                place = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                hit = keys[place] == own if len(keys) else np.zeros(len(own), bool)
                place, sent = place[hit], of[word[hit]]
                order = np.lexsort((place, sent))
                place, sent = place[order].tolist(), sent[order]
                first = np.searchsorted(sent, np.arange(len(owner) + 1)).tolist()
                bags: list[dict] = [{} for _ in range(end - at)]
                for j, text in enumerate(owner.tolist()):
                    bag = tuple(place[first[j] : first[j + 1]])
                    bags[text][bag] = bags[text].get(bag, 0) + 1
                rows += [{"sizes": list(map(len, b)), "terms": [t for bag in b for t in bag], "times": list(b.values())} for b in bags]
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array([r[c] for r in rows], pa.list_(pa.int32())) for c in ("sizes", "terms", "times")]], names=["doc_id", "y", "sizes", "terms", "times"])

    table = taken.mapInArrow(run, "doc_id long, y double, sizes array<int>, terms array<int>, times array<int>").toArrow().combine_chunks().sort_by("doc_id")
    flat = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n_bags = np.array([len(x) for x in table["sizes"]], np.int64)
    sizes = flat("sizes")
    return Bags(flat("terms"), np.repeat(np.arange(len(sizes)), sizes), flat("times").astype(float), np.repeat(np.arange(len(n_bags)), n_bags), table["y"].to_numpy().astype(float))


def train(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, remainder: int = 0, rows: int = 20000, least_texts: int = 5) -> Model:
    """Fit on at most `rows` labelled documents whose crc32(doc_id) mod modulus isn't remainder.

    No text leaves the executors: they count the documents of each term, and send the sentences as
    numbers of useful terms, which are few. Null and empty texts and texts without words have no
    sentences and are taken for clean. Null ids and null labels are left out; of repeated ids one
    text counts, of conflicting labels 1. Without rows, or with one label only, every text gets that
    label. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    taken = cut(sample(docs, labels, "toxic", held_out(F.col("doc_id"), modulus, remainder), rows).select(F.col("doc_id").cast("long"), "y", "text"))
    keys = _useful(taken, least_texts)
    return fit(_bags(taken, keys), keys)


def score(docs: DataFrame, model: Model, *, modulus: int = 5, remainder: int = 0, top: int | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and the worst sentences of every whole text.

    worst: all sentences with a score of 0.5 or more (with `top` so many at most), largest first, as (start, end, score), in bytes of
    the UTF-8 text from its first to its last word. Null and empty texts and texts without words
    have a score of 0. Null ids aren't held out. Repeated rows are scored each. labels, lang,
    source and doc_id aren't used. Empty in, empty out.
    """
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            worst: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for at, end, data, offsets in chunks(strings(batch.column(1))):
                words = Words(data, offsets)
                of, owner = sentences(words, offsets)
                if not len(owner):
                    continue
                own, word = terms(words)
                z = model.sentence_scores(own, of[word], len(owner))
                log_clean, s = noisy_or(z, owner, end - at)
                scores[at:end] = -np.expm1(log_clean)
                for j in np.flatnonzero(s >= 0.5).tolist():
                    a, b = np.searchsorted(of, [j, j + 1])
                    base = offsets[owner[j]]
                    worst[at + owner[j]].append({"start": int(words.starts[a] - base), "end": int(words.ends[b - 1] - base), "score": float(s[j])})
            worst = [sorted(x, key=lambda d: (-d["score"], d["start"]))[:top] for x in worst]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.clip(scores, 0, 1)), pa.array(worst, spans)], names=["doc_id", "held_out", "score", "worst"])

    small_batches(docs.sparkSession)
    fold = held_out(F.col("doc_id"), modulus, remainder).alias("held_out")
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), fold).mapInArrow(run, "doc_id long, held_out boolean, score double, worst array<struct<start: long, end: long, score: double>>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst")


def drop_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """docs with the columns it has, without the rows that score the threshold or more: one scan, no shuffle.

    Null and empty texts and texts without words score 0 and stay; repeated rows go or stay together.
    Only text is looked at, and columns of any name come back as they are. Empty in, empty out.
    """

    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for a, end, data, offsets in chunks(strings(batch.column(at))):
                words = Words(data, offsets)
                of, owner = sentences(words, offsets)
                if len(owner):
                    own, word = terms(words)
                    log_clean, _ = noisy_or(model.sentence_scores(own, of[word], len(owner)), owner, end - a)
                    good[a:end] = -np.expm1(log_clean) < threshold
            yield batch.filter(pa.array(good))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
