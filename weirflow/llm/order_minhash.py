"""Near-duplicates by Order MinHash, verified by banded alignment.

Order MinHash (Marcais and others, 2019): each sketch takes the few smallest of the document's
occurrence-labelled k-mers under a hash of its own and keeps them in text order, so it is
sensitive to the order of the text, as the edit similarity is. k-mers are runs of five words.
Documents that agree in a sketch meet in its bucket. A bucket of any size is compared with its
smallest id; members that aren't connected by that meet again in the smaller buckets of two and
three sketches, with four of each. What is still unconnected in a bucket then is joined exactly,
by the rarest k-mers of each text: two texts that reach the threshold share one of these.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, joined
from .session import TASK_ROWS, cut, fresh, lookup, release, remove, small, small_batches, written
from .textbytes import Words, chunks, labelled, mix, shingles, strings


def sketch(kmers: np.ndarray, xors: np.ndarray, factors: np.ndarray, size: int) -> np.ndarray:
    """One number for each hash function: its `size` smallest labelled k-mers in text order."""
    out = np.zeros(len(xors), np.uint64)
    n = min(size, len(kmers))
    rows = max(1, (1 << 20) // max(1, len(kmers)))  # bounds memory for very long texts
    for at in range(0, len(xors), rows):
        keys = (kmers[None, :] ^ xors[at : at + rows, None]) * factors[at : at + rows, None]
        if n < len(kmers):
            least = np.sort(np.argpartition(keys, n - 1, axis=1)[:, :n], axis=1)
        else:
            least = np.broadcast_to(np.arange(n), (len(keys), n))
        own = kmers[least]
        total = np.full(len(keys), n, np.uint64)
        for j in range(n):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + own[:, j])
        out[at : at + rows] = total
    return out


def alignment_similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Matches of the best alignment over all that either has (0 if that can't reach the threshold).

    a, b: labelled k-mers, so no element repeats and the longest common subsequence is the longest
    increasing run of places. An alignment that reaches the threshold t has at most
    (|a| + |b|)(1 - t)/(1 + t) insertions and deletions: places further apart lie outside the band.
    """
    total = len(a) + len(b)
    need = threshold * total / (1 + threshold) - 1e-9
    if not total or min(len(a), len(b)) < need:
        return 0.0
    order = np.argsort(b, kind="stable")
    spot = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    place = order[spot]
    same = b[place] == a
    band = int(total * (1 - threshold) / (1 + threshold) + 1e-9)
    same &= np.abs(place - np.arange(len(a))) <= band
    places = place[same]
    if len(places) < need:
        return 0.0
    if (np.diff(places) > 0).all():
        matches = len(places)
    else:
        tails: list[int] = []
        for p in places.tolist():
            i = bisect_left(tails, p)
            tails[i : i + 1] = [p]
        matches = len(tails)
    return matches / (total - matches) if matches >= need else 0.0


def _labelled_texts(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, bytes, np.ndarray]]:
    """(row, word hashes, digest, labelled k-mers); a text without words is known by its bytes."""
    texts = strings(column)
    for at, end, data, offsets in chunks(texts):
        words = Words(data, offsets)
        hashes = words.hashes()
        for i in range(end - at):
            own = hashes[words.first[i] : words.first[i + 1]]
            body = own.tobytes() if len(own) else b"\0" + data[offsets[i] : offsets[i + 1]].tobytes()
            yield at + i, own, hashlib.blake2b(body, digest_size=16).digest(), labelled(shingles(own, k))


def _sketches(docs: DataFrame, k: int, sketches: int, size: int) -> DataFrame:
    xors = _numbers(1, sketches)
    factors = _numbers(2, sketches) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = np.zeros((batch.num_rows, 2), np.int64)
            sizes = np.zeros(batch.num_rows, np.int32)
            found = np.zeros((batch.num_rows, sketches), np.int64)
            for row, _, digest, kmers in _labelled_texts(batch.column(1), k):
                digests[row] = np.frombuffer(digest, np.int64)
                sizes[row] = len(kmers)
                if len(kmers):
                    found[row] = sketch(kmers, xors, factors, size).view(np.int64)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * sketches)
            yield pa.record_batch([batch.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], names=["doc_id", "d1", "d2", "n", "sk"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, d1 long, d2 long, n int, sk array<long>")


def _numbers(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D) + np.uint64(seed))


def _kmers(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, seq): labelled k-mers, four bytes each, of the documents named in ids, read again from the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [kmers.astype("<u4").tobytes() for _, _, _, kmers in _labelled_texts(batch.column(1), k)]
            yield pa.record_batch([batch.column(0), pa.array(seqs, pa.binary())], names=["id", "seq"])

    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    return named.join(small(ids), "id", "left_semi").mapInArrow(run, "id long, seq binary")


def _hot_ends(pairs: DataFrame, end: str) -> DataFrame:
    """(end, pieces): the documents at this end of more pairs than a task takes."""
    times = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > TASK_ROWS)
    return cut(times.select(end, F.ceil(F.col("times") / TASK_ROWS).cast("int").alias("pieces")))


def _with_kmers(pairs: DataFrame, hot: DataFrame, seqs: DataFrame, end: str) -> DataFrame:
    """pairs with the k-mers of one end; the pairs of a hot end are dealt over tasks, and its k-mers go to each of these."""
    side = seqs.select(F.col("id").alias(end), F.col("seq").alias(f"s{end}"))
    if hot.isEmpty():
        return pairs.join(side, end)
    pieces, hot = F.coalesce("pieces", F.lit(1)), small(hot, 12)
    dealt = pairs.join(hot, end, "left").withColumn("piece", F.pmod(F.xxhash64("a", "b"), pieces).cast("int")).drop("pieces")
    copied = side.join(hot, end, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    return dealt.join(copied, [end, "piece"]).drop("piece")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, threshold: float, seqs: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the threshold; seqs: the k-mers of all of them, if they were read before."""
    if seqs is None:
        ids = cut(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct())
        seqs = _kmers(docs, ids, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                good.append(alignment_similarity(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), threshold) >= threshold)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs
    for end in "ab":
        both = _with_kmers(both, _hot_ends(pairs, end), seqs, end)
    found = cut(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct())
    release(docs.sparkSession)
    return found


def _fitting(pairs: DataFrame, unique: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose lengths allow the threshold; an id with several texts allows what one of them does."""
    sizes = unique.groupBy("id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    first = sizes.select(F.col("id").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    second = sizes.select(F.col("id").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    both = pairs.join(first, "a").join(second, "b")
    return both.where((F.col("hb") >= F.lit(threshold) * F.col("la")) & (F.col("ha") >= F.lit(threshold) * F.col("lb"))).select("a", "b")


def _joined(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _unsettled(members: DataFrame, least: int = 2) -> DataFrame:
    """Members of the buckets that hold more than one component and at least so many members."""
    several = members.groupBy("bucket").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("_n")).where((F.col("_lo") < F.col("_hi")) & (F.col("_n") >= least)).select("bucket")
    return members.join(small(cut(several)), "bucket")


#: k-mers are counted by their highest bits; a k-mer's list is joined in blocks of about so many documents.
SLOT_BITS, BLOCK = 20, 1000


def _flat(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All k-mers of a batch and the offsets of each row's."""
    offsets = np.frombuffer(seqs.buffers()[1], np.int32)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64)
    body = seqs.buffers()[2]
    kmers = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]].view("<u4") if body is not None and body.size else np.zeros(0, "<u4")
    return kmers, (offsets - offsets[0]) // 4


def _rarity(seqs: DataFrame) -> np.ndarray:
    """For each slot of k-mers how often they occur, in quarters of a power of two: a megabyte, however many there are."""
    shift = np.uint32(32 - SLOT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0] >> shift, minlength=len(total))
        used = np.flatnonzero(total)
        for at in range(0, len(used), 1 << 16):
            some = used[at : at + (1 << 16)]
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "n"])

    found = seqs.select("seq").mapInArrow(run, "slot int, n long").groupBy("slot").agg((F.log2(F.sum("n")) * 4).cast("short").alias("level")).toArrow()
    levels = np.zeros(1 << SLOT_BITS, np.uint8)
    levels[found["slot"].to_numpy()] = found["level"].to_numpy()
    return levels


def _close(seqs: DataFrame, comps: DataFrame, threshold: float, made: list[str]) -> DataFrame:
    """The pairs (a, b) of different components that their k-mers don't rule out: no other pair reaches the threshold.

    In any order of all k-mers, places counted from 0, all that two texts share lies at or behind
    the first k-mer that they share, so from there each must have the t/(1 + t) of the sum of both
    lengths that an alignment at t needs. That k-mer lies in the first 1 - t of each text. The
    rarest come first, hence lists of a k-mer are short and hold hardly any text of a shared form.
    """
    levels, shift = _rarity(seqs), np.uint32(32 - SLOT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kmers, offsets = _flat(batch.column(1))
            keys = (levels[kmers >> shift].astype(np.uint64) << np.uint64(32)) | kmers
            sizes = np.diff(offsets)
            heads = [np.sort(keys[a:b])[: b - a - int(np.ceil(threshold * (b - a) - 1e-9)) + 1] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            lengths = np.array([len(h) for h in heads], np.int64)
            place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            own = np.repeat(np.arange(len(heads)), lengths)
            kmer = (np.concatenate([*heads, np.zeros(0, np.uint64)]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            yield pa.record_batch([pa.array(kmer), batch.column(0).take(pa.array(own)), pa.array(sizes[own].astype(np.int32)), pa.array((sizes[own] - place).astype(np.int32))], names=["kmer", "id", "n", "rest"])

    heads = written(_joined(seqs.select("id", "seq").mapInArrow(run, "kmer long, id long, n int, rest int"), comps), "heads", made)
    lists = heads.groupBy("kmer").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("_lo < _hi").select("kmer", "blocks")
    listed = heads.join(lists, "kmer")
    left = listed.select("kmer", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    right = listed.select("kmer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9
    met = left.join(right, (left["kmer"] == right["kmer"]) & (left["block"] == right["block"]) & (F.col("ca") < F.col("cb")) & (F.col("ra") >= need) & (F.col("rb") >= need))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ca", "cb").distinct()


def _exact(buckets: DataFrame, comps: DataFrame, tested: DataFrame, docs: DataFrame, k: int, threshold: float, made: list[str]) -> DataFrame:
    """comps after all pairs that share a bucket, aren't connected and weren't tested are compared or ruled out.

    Of what may be links between two components one is tested first, then all that are left.
    """
    # the two of a bucket of two have been compared
    ids = cut(_unsettled(_joined(buckets, comps), 3).select("id").distinct())
    if ids.isEmpty():
        return comps
    seqs = written(_kmers(docs, ids, k), "kmers", made)
    pairs = cut(_close(seqs, comps, threshold, made).join(tested, ["a", "b"], "left_anti"))
    release(docs.sparkSession)
    for first in (True, False):
        now = pairs
        if first:
            now = pairs.groupBy("ca", "cb").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
        now = cut(now.select("a", "b"))
        if now.isEmpty():
            break
        more = _verified(now, docs, k, threshold, seqs)
        if not more.isEmpty():
            comps = joined(comps, more)
        if first:
            left = pairs.select("a", "b").join(now, ["a", "b"], "left_anti")
            ends = [comps.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
            pairs = cut(left.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    return comps


#: Sketches, counted from the last one of a bucket, by which it is dealt again: second and third level.
REFINE = ((1, 2, 3), (1, 2))


def near_duplicates(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, sketches: int = 16, size: int = 3) -> DataFrame:
    """One row for each input row: doc_id, class_id, representative.

    class_id is the smallest doc_id among the documents that a chain of links joins; a link is an
    alignment similarity of the five-word k-mers of at least the threshold (insertions and
    deletions of k-mers; at most the Jaccard similarity). representative: doc_id is class_id, true
    for one of repeated rows too (all rows that share the id). Documents with the same words are one
    class; without words, with the same bytes (null counts as empty). Of fewer than five words the
    words as a whole are the k-mer. Rows with a null doc_id join the class of their words but link
    no others; if all of a class are null, class_id is null. Rows that share a doc_id are one
    document for links. Other columns are not looked at. Empty in, empty out.
    16 sketches of 3 k-mers find a pair at a Jaccard similarity of 0.8 with 1 - (1 - 0.8**3)**16,
    that is 0.99999; every pair that is found so and reaches the threshold is in one class.
    """
    small_batches(docs.sparkSession)
    made: list[str] = []
    rows = cut(_sketches(docs, k, sketches, size))
    # only words that several rows have are joined back; a large group of copies is dealt over tasks
    several = cut(rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("times")).where("times > 1"))
    copies = lookup(rows.select("doc_id", "d1", "d2", "n", "sk"), several.withColumn("copied", F.lit(True)), ["d1", "d2"], "times", "left", 48)
    copies = copies.withColumn("rep", F.when(F.col("copied"), F.col("rep")).otherwise(F.col("doc_id")))
    unique = copies.where("n > 0 AND doc_id = rep").select(F.col("doc_id").alias("id"), "n", "sk")
    unique = cut(unique.dropDuplicates(["id", "sk"]))
    copies = copies.select("doc_id", "rep")

    # a bucket's number holds in its lowest bits which sketch it is of
    low = (1 << (sketches - 1).bit_length()) - 1
    number = lambda last, *of: F.xxhash64(*of).bitwiseAND(F.lit(~low)).bitwiseOR(last.cast("long"))
    in_bucket = unique.select("id", F.posexplode("sk").alias("last", "v")).select("id", number(F.col("last"), "last", "v").alias("bucket"))
    shared = in_bucket.groupBy("bucket").agg(F.min("id").alias("rep"), F.max("id").alias("_most")).where("rep < _most").select("bucket", "rep")
    # written first, so that the join can be split at a hot bucket
    with_rep = written(in_bucket.join(small(cut(shared)), "bucket").select("bucket", "id", "rep"), "buckets", made)
    buckets = members = with_rep.select("bucket", "id")
    tested = cut(_fitting(with_rep.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), unique, threshold))
    comps = components(_verified(tested, docs, k, threshold))

    # buckets with members that aren't connected yet are dealt again by a second and a third sketch:
    # documents at 0.8 agree in many of these (12 and 13 on average), documents that share a passage
    # hardly ever, and four of each of these small buckets are compared with all that they aren't connected to
    for steps in REFINE:
        rest = _unsettled(_joined(members, comps))
        turn = F.explode(F.array(*[F.pmod(F.col("bucket").bitwiseAND(F.lit(low)) + F.lit(d), F.lit(sketches)).cast("int") for d in steps]))
        dealt = rest.join(unique.select("id", "sk"), "id").select("id", "sk", "bucket", turn.alias("last"))
        dealt = dealt.select("id", number(F.col("last"), "bucket", "last", F.get("sk", F.col("last"))).alias("bucket"))
        now = written(_unsettled(_joined(dealt, comps)).select("bucket", "id", "comp"), "buckets", made)
        if now.isEmpty():
            break
        members = now.select("bucket", "id")
        by_id, by_hash = F.struct("id", "comp"), F.struct(F.xxhash64("id").alias("h"), "id", "comp")
        ends = now.groupBy("bucket").agg(F.min(by_id).alias("a"), F.max(by_id).alias("b"), F.min(by_hash).alias("c"), F.max(by_hash).alias("d"))
        ends = ends.select("bucket", F.array("a", "b", *[F.struct(f"{x}.id", f"{x}.comp") for x in "cd"]).alias("ends"))
        pairs = now.join(small(cut(ends), 150), "bucket").select("id", "comp", F.explode("ends").alias("end")).where(F.col("comp") != F.col("end.comp"))
        pairs = pairs.select(F.least("id", "end.id").alias("a"), F.greatest("id", "end.id").alias("b")).distinct()
        pairs = cut(_fitting(pairs.join(tested, ["a", "b"], "left_anti"), unique, threshold))
        more = _verified(pairs, docs, k, threshold)
        tested = cut(tested.unionAll(pairs))
        if not more.isEmpty():
            comps = joined(comps, more)
    comps = _exact(buckets, comps, tested, docs, k, threshold, made)
    remove(docs.sparkSession, *made)  # what is left to compute reads checkpoints only
    # all copies of a text meet its component in one row: their number is that row's weight
    times = several.where("rep IS NOT NULL").groupBy("rep").agg(F.sum("times").alias("times"))
    found = cut(comps.withColumnRenamed("id", "rep").join(times, "rep", "left").withColumn("times", F.coalesce("times", F.lit(1))))
    out = lookup(copies, found, ["rep"], "times", "left", 48)
    cls = F.coalesce("comp", "rep")
    return out.select("doc_id", cls.alias("class_id"), F.col("doc_id").eqNullSafe(cls).alias("representative"))


def keep_representatives(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs without the documents that aren't the representative of their class.

    Rows with a null doc_id stay, as do repeated rows of a representative: equal rows are the exact
    stage's task. Columns of any name come back as they are. Empty in, empty out.
    """
    gone = cut(classes.where("NOT representative AND doc_id IS NOT NULL").select(F.col("doc_id").alias(fresh(docs) + "id")).distinct())
    return docs.join(small(gone, 24), F.col("doc_id") == gone[gone.columns[0]], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
