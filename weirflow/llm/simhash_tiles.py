"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

The bits of a fingerprint are counted in each of several equal parts. Two fingerprints differ in at
least as many bits as these counts do together, so tiles of equal counts need to be compared only
with tiles whose counts are no further away than the radius; all others are skipped without loss.
A pair of tiles is compared whole, by exclusive-or and bit counts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import cut, lookup, small, small_batches

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
#: Fingerprints of a tile that are compared with others at once, and others at once; larger tiles are split.
TILE, VISITORS = 4096, 8 * 4096
#: Cells of a comparison that are held at a time, hashes whose bits are counted at a time.
CELLS, HASHES = 1 << 20, 1 << 16
#: Parts of a fingerprint up to so many distinct fingerprints: more parts make finer tiles and more neighbours. Every choice gives the same links.
PARTS = ((10_000_000, 4), (1_000_000_000, 8), (1 << 62, 16))


def fingerprint(text: str, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the hashes of the runs of `width` words, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    data = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, last = (ends - sizes).tolist(), ends.tolist()[min(width, len(words)) - 1 :]
    counts, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, HASHES):
        part = [xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts[at : at + HASHES], last[at : at + HASHES], strict=False)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(t or "", width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def tile_counts(prints: np.ndarray, parts: int) -> np.ndarray:
    """The number of ones in each part: a row for each fingerprint."""
    bits = 64 // parts
    shifts = np.arange(parts, dtype=np.uint64) * np.uint64(bits)
    return np.bitwise_count((prints[:, None] >> shifts) & np.uint64((1 << bits) - 1)).astype(np.int64)


def steps(parts: int, radius: int) -> np.ndarray:
    """Differences of counts that sum to the radius at most; one of each pair of opposite ones, none first."""
    found = [(0,) * parts]
    for size in range(1, min(radius, parts) + 1):
        for places in combinations(range(parts), size):
            for values in product([v for v in range(-radius, radius + 1) if v], repeat=size):
                if sum(map(abs, values)) <= radius and values[0] > 0:
                    step = [0] * parts
                    for p, v in zip(places, values, strict=True):
                        step[p] = v
                    found.append(tuple(step))
    return np.array(found, np.int64)


def _placed(parts: int, radius: int):
    """Batches of fp to rows (tile, fp, home): a row in its own tile, and one in each tile that it is compared with."""
    weights = np.array([(64 // parts + 1) ** j for j in range(parts)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = steps(parts, radius)
        for b in batches:
            signed = b.column(0).to_numpy()
            for at in range(0, len(signed), HASHES):
                some = signed[at : at + HASHES]
                counts = tile_counts(some.view(np.uint64), parts)
                for k, move in enumerate(moves):
                    there = counts + move
                    inside = ((there >= 0) & (there <= 64 // parts)).all(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(there[inside] @ weights), pa.array(some[inside]), pa.array(np.full(int(inside.sum()), k == 0))], ["tile", "fp", "home"])

    return run


def _split(placed: DataFrame, tile: int, visitors: int) -> DataFrame:
    """placed with the pieces (i, q) of its tile in which a row is compared, and whether it is at home there.

    A tile with many fingerprints is cut into pieces i of its own and q of visiting ones. Piece i is
    compared with itself where q is 0, and with all visitors, among which are the pieces after it.
    Pieces are dealt by hashes of the fingerprints.
    """
    sizes = placed.groupBy("tile").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("other"))
    many = cut(sizes.where((F.col("own") > tile) | (F.col("other") > visitors)).select("tile", F.ceil(F.col("own") / tile).cast("int").alias("k"), F.ceil((F.col("own") + F.col("other")) / visitors).cast("int").alias("m")))
    rows = placed.join(small(many, 24), "tile", "left").select("tile", "fp", "home", F.greatest(F.coalesce("k", F.lit(1)), F.lit(1)).alias("k"), F.coalesce("m", F.lit(1)).alias("m"))
    rows = rows.withColumns({"s": F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"), "v": F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("m")).cast("int")})
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    at_home = F.transform(upto(F.col("m")), lambda q: F.struct(F.col("s").alias("i"), q.alias("q"), F.lit(True).alias("home")))
    visits = lambda n: F.transform(F.when(n > 0, upto(n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("i"), F.col("v").alias("q"), F.lit(False).alias("home")))
    pieces = F.when(F.col("home"), F.concat(at_home, visits(F.col("s")))).otherwise(visits(F.col("k")))
    return rows.select("tile", "fp", F.explode(pieces).alias("p")).select("tile", "p.i", "p.q", "p.home", "fp")


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, the least place of each place's group, after the links a, b."""
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        la, lb = label[a], label[b]
        label = label.copy()
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while ((above := label[label]) != label).any():
            label = above
    return label


def compared(own: np.ndarray, other: np.ndarray, inside: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius: between own and other, and inside own; to the least place of each group, so fewer than there are fingerprints."""
    both = np.concatenate([own, other])
    label, first = np.arange(len(both)), 0 if inside else len(own)
    if len(own) and len(both) > first:
        rows = max(1, CELLS // (len(both) - first))
        for at in range(0, len(own), rows):
            near = np.bitwise_count(own[at : at + rows, None] ^ both[None, first:]) <= radius
            i, j = np.nonzero(near)
            label = _merged(label, i + at, j + first)
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def _linked(radius: int):
    """Batches ordered by (tile, i, q) to rows (a, b); what a piece holds is bounded by TILE and VISITORS, on average."""

    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows)
        prints, home = whole["fp"].to_numpy().view(np.uint64), whole["home"].to_numpy()
        a, b = compared(prints[home], prints[~home], whole["q"][0].as_py() == 0, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != keys[0, c] for c in range(3)):
                yield done(held)
                held = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                held.append(b.slice(x, y - x))
                if y < b.num_rows:
                    yield done(held)
                    held = []
        if held:
            yield done(held)

    return run


def links(prints: DataFrame, radius: int = 2, parts: int | None = None, tile: int = TILE, visitors: int = VISITORS) -> DataFrame:
    """(a, b) of distinct fingerprints `fp` that connect exactly what lies within the radius.

    A piece of a tile gives links to the least of each group that it connects, not all pairs, so a
    crowd of near copies gives no more links than it has members in each piece.
    """
    if parts is None:
        n = prints.count()
        parts = next(p for most, p in PARTS if n <= most)
    placed = prints.select("fp").mapInArrow(_placed(parts, radius), "tile long, fp long, home boolean")
    pieces = _split(placed, tile, visitors)
    by = ["tile", "i", "q"]
    ordered = pieces.repartition(*by).sortWithinPartitions(*by).select(*by, "home", "fp")
    return ordered.mapInArrow(_linked(radius), "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 3, radius: int = 2, parts: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    fingerprint: 16 hexadecimal digits. component_id: the smallest doc_id that is reached over
    fingerprints within the radius, the row's own included. Null and empty texts, and texts of white
    space, have the fingerprint zero and are linked like any other. Repeated rows have one result
    each; a null doc_id links what lies within the radius of it, but is no component_id unless no
    id is reached. Other columns aren't looked at; empty in, empty out.
    """
    rows = cut(fingerprints(docs, width))
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")))
    comps = components(links(groups, radius, parts)).select(F.col("id").alias("fp"), "comp")
    linked = cut(groups.join(comps, "fp"))
    best = linked.groupBy("comp").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("n"))
    linked = lookup(linked, best, ["comp"], "n").select("fp", F.col("best").alias("component_id"), "times")
    # a fingerprint of one document that is linked to no other stands for itself
    alone = groups.where("times > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"), "times")
    found = lookup(rows, linked.unionAll(alone), ["fp"], "times", how="left")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
