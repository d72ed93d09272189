"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

A window of a document with as many words as a benchmark item is fingerprinted: 256 bits of SimHash
over its five-word shingles, each with the number of its occurrence, so that sets of them intersect
as multisets do. Fingerprints meet items in a multi-index of Hamming blocks: of two fingerprints
that differ in 63 bits or fewer, one of the 16 blocks of 16 bits differs in 3 or fewer (16 times 4
is 64). The items stand in the index under every value within 3 bits of each of their blocks, so
a window looks up its 16 blocks. Candidates within the radius are verified by the exact
multiset-weighted Jaccard similarity of their shingles.

Windows that can't match any item of their size aren't fingerprinted: a similarity of t takes
2tm/(1+t) positions of a window of m whose shingles occur in items of this size, and a window that
begins with one of these holds whatever a window further left holds. This sieve doesn't look at
which item a shingle is of; the fingerprints find that.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import BROADCAST_BYTES, TABLE_ROW, cut, fresh, small

WORD_GAP = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Bits of a fingerprint and of a block, radius of a pair and, by pigeonhole, of one of its blocks.
BITS, BLOCK_BITS, RADIUS = 256, 16, 63
LONGS, BLOCKS = BITS // 64, BITS // BLOCK_BITS
BLOCK_RADIUS = RADIUS // BLOCKS
#: Bits of the bitmap of items' shingles: so many for each, and at most (8 MB) and at least so many.
SIEVE_EACH, SIEVE_MOST, SIEVE_LEAST = 16, 1 << 26, 1 << 12


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is computed once (a plain column may be inlined into each use)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _words(col: str) -> str:
    return f"array_remove(split(lower(coalesce(CAST({col} AS STRING), '')), '{WORD_GAP}'), '')"


def _shingles(words: str, k: int) -> str:
    own = ", ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return _let(words, "w", f"IF(size(w) >= {k}, transform(sequence(0, greatest(size(w) - {k}, 0)), i -> xxhash64({own})), CAST(array() AS array<bigint>))")


def _labelled(arr: str) -> str:
    """Shingles with the number of their occurrence: sets of these intersect as multisets do."""
    return _let(arr, "v", "IF(size(array_distinct(v)) = size(v), transform(v, h -> xxhash64(h, 1)), transform(v, (h, i) -> xxhash64(h, size(filter(slice(v, 1, i + 1), o -> o = h)))))")


def _simhash(arr: str, longest: int) -> str:
    """BITS majority bits over a set of hashes, in longs.

    The counts of 64 bits are kept in bit planes (plane j holds the bits of weight 2**j of all 64
    counters), to which a hash is added with carries, and compared with the half plane by plane.
    longest: the size of the largest set bounds the planes.
    """
    planes = range(max(1, longest.bit_length()))

    def long_of(c: int) -> str:
        word = "h" if c == 0 else f"xxhash64(h, {c})"
        add = ", ".join(f"'p{j}', s.p{j} ^ ({' & '.join([f's.p{i}' for i in range(j)] + ['x'])})" for j in planes)
        zero = ", ".join(f"'p{j}', 0L" for j in planes)
        step = _let(word, "x", f"named_struct({add})")
        counts = f"aggregate(v, named_struct({zero}), (s, h) -> {step}, s -> array({', '.join(f's.p{j}' for j in planes)}))"
        # counter >= n / 2 + 1, from the highest plane down: already greater, or equal so far
        half = "-(shiftright(size(v) div 2 + 1, j) & 1L)"
        compare = f"named_struct('gt', a.gt | (a.eq & p[j] & ~t), 'eq', a.eq & ~(p[j] ^ t))"
        majority = f"aggregate(sequence({len(planes) - 1}, 0), named_struct('gt', 0L, 'eq', -1L), (a, j) -> {_let(half, 't', compare)}, a -> a.gt | a.eq)"
        return _let(counts, "p", majority)

    return _let(arr, "v", f"array({', '.join(long_of(c) for c in range(LONGS))})")


def _block(fp: str, b: str) -> str:
    per = 64 // BLOCK_BITS
    return f"shiftrightunsigned({fp}[CAST({b} AS INT) div {per}], CAST({b} % {per} * {BLOCK_BITS} AS INT)) & {(1 << BLOCK_BITS) - 1}L"


def _key(size: str, block: str, value: str) -> str:
    """One number for (window size, block, value): the index joins on it."""
    return f"shiftleft(CAST({size} AS BIGINT), {BLOCK_BITS + 8}) | shiftleft(CAST({block} AS BIGINT), {BLOCK_BITS}) | {value}"


def near_values() -> list[int]:
    """What a block's value is xored with to give every value within BLOCK_RADIUS bits of it."""
    return [sum(1 << b for b in bits) for n in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_key, item_id, start_word, n_words, similarity: the best window of each document that holds an item.

    Words are runs of ASCII letters and digits and of all other non-ASCII characters, lower-cased.
    Items shorter than five words are matched by shingles of their own length. A document shorter
    than an item is one window. Null and empty texts match nothing; a null doc_id is reported as
    null; text_key (a hash of the text) tells such rows apart. Of windows with the same similarity
    the first that begins with a word run of an item counts. Repeated rows are reported once. Other
    columns are not looked at. Empty tables give an empty result.
    At a similarity of 0.8 the angle between windows is 27 degrees: 38.8 of 256 bits differ on
    average with a deviation of 5.7, and two pairs in 100,000 lie beyond the radius of 63.
    """
    items = cut(benchmark.select(F.col("item_id"), F.expr(_words("text")).alias("_w")).where("size(_w) > 0").withColumn("_k", F.least(F.size("_w"), F.lit(shingle))))
    sizes = sorted(r[0] for r in items.select("_k").distinct().collect())  # 1 to shingle: five rows at most
    if not sizes:
        sizes = [shingle]
    found = [_for_size(docs, items.where(F.col("_k") == k), k, threshold) for k in sizes]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("_start"), "n_words")).alias("_best")
    return out.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", (-F.col("_best._start")).alias("start_word"), "_best.n_words", "_best.similarity")


def sieve(known: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row with one array, a bitmap that has a bit for each hash `_h` of the n of known, and the number of its bits."""
    bits = min(max(SIEVE_LEAST, 1 << (SIEVE_EACH * n - 1).bit_length()), SIEVE_MOST)
    at = known.select(F.expr(f"pmod(_h, {bits}L)").alias("_at"))
    set_ = at.groupBy(F.expr("_at div 64").alias("id")).agg(F.expr("bit_or(shiftleft(1L, CAST(_at % 64 AS INT)))").alias("_v"))
    longs = known.sparkSession.range(bits // 64).join(set_, "id", "left").select("id", F.coalesce("_v", F.lit(0)).alias("_v"))
    return cut(longs.agg(F.expr("transform(sort_array(collect_list(struct(id, _v))), x -> x._v)").alias("_bits"))), bits


def _windows(docs: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    """(_id, _own, _sizes): for each document with such windows the starts of those of each size."""
    known = cut(items.select("_m", F.explode(F.array_distinct("_item")).alias("_h")).distinct())
    hashed = docs.select("doc_id", F.xxhash64("text").alias("_key"), F.expr(_shingles(_words("text"), k)).alias("_sh")).withColumn("_n", F.size("_sh"))
    # the outer form: Spark would infer a filter from the plain one and compute the shingles for it once more
    at = hashed.select("doc_id", "_key", "_n", F.posexplode_outer("_sh").alias("_pos", "_h"))
    n = known.count()
    if n * (16 + TABLE_ROW) > BROADCAST_BYTES:
        # both sides of the join are shuffled: only the shingles that the bitmap lets through
        bitmap, bits = sieve(known, n)
        at = at.withColumn("_long", F.get(bitmap.scalar(), F.expr(f"CAST(pmod(_h, {bits}L) div 64 AS INT)")))
        at = at.where(f"(shiftrightunsigned(_long, CAST(pmod(_h, {bits}L) % 64 AS INT)) & 1) = 1").drop("_long")
    hits = at.join(small(known, 16), "_h").groupBy("doc_id", "_key", "_m", "_n").agg(F.sort_array(F.collect_set("_pos")).alias("_p"))
    whole, part = 2 * threshold / (1 + threshold), threshold
    need = f"greatest(1, CAST(ceil(IF(_n >= _m, {whole!r}, {part!r}) * _m - 1e-9D) AS INT))"
    hits = hits.withColumn("_need", F.expr(need)).where("size(_p) >= _need")
    starts = (
        "array_distinct(transform(filter(sequence(0, size(_p) - _need), j -> _p[j + _need - 1] - _p[j] < _m),"
        " j -> greatest(0, least(_p[j], _n - _m))))"
    )
    found = hits.select("doc_id", "_key", "_m", F.expr(starts).alias("_s")).where("size(_s) > 0")
    return cut(found.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_own")).agg(F.collect_list(F.struct("_m", "_s")).alias("_sizes")))


def fingerprinted_items(items: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(item_id, _m, _item, _set, _fp) and the size of the largest item."""
    sets = cut(items.select("item_id", F.expr(_shingles("_w", k)).alias("_item")).select("item_id", "_item", F.size("_item").alias("_m"), F.expr(_labelled("_item")).alias("_set")))
    longest = sets.agg(F.max("_m")).first()[0] or 1
    return cut(sets.withColumn("_fp", F.expr(_simhash("_set", longest)))), longest


def index(items: DataFrame) -> DataFrame:
    """(_at, item_id) of the multi-index: every value within BLOCK_RADIUS bits of every block of every item."""
    blocks = items.select("item_id", "_m", "_fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("_b"))
    values = blocks.select("item_id", "_m", "_b", F.expr(_block("_fp", "_b")).alias("_v"), F.explode(F.lit(near_values())).alias("_x"))
    return values.select(F.expr(_key("_m", "_b", "(_v ^ CAST(_x AS BIGINT))")).alias("_at"), F.col("item_id").alias("_found"))


def _for_size(docs: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    items, longest = fingerprinted_items(items, k)
    windows = _windows(docs, items, k, threshold)
    # the texts of the few documents that have such windows are read again
    again = docs.select("doc_id", F.xxhash64("text").alias("_key"), "text").join(small(windows, F.lit(40) + 4 * F.aggregate("_sizes", F.lit(0), lambda n, s: n + 8 + F.size(s["_s"]))), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_own")))
    own = again.select("doc_id", "_key", F.expr(_shingles(_words("text"), k)).alias("_sh"), F.explode_outer("_sizes").alias("_size"))
    own = own.select("doc_id", "_key", "_sh", "_size._m", F.explode_outer("_size._s").alias("_start"))
    own = own.select("doc_id", "_key", "_m", "_start", F.expr(_labelled("slice(_sh, _start + 1, _m)")).alias("_win"))
    own = own.withColumn("_own_fp", F.expr(_simhash("_win", longest)))
    own = cut(own.dropDuplicates(["doc_id", "_key", "_m", "_start"]))

    looked = own.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("_at", F.expr(_key("_m", "_b", f"({_block('_own_fp', '_b')})")))
    met = looked.join(small(cut(index(items)), 24), "_at")
    near = met.join(small(items, F.lit(80) + 8 * F.size("_item") + 8 * F.size("_set")), F.col("_found") == F.col("item_id"))
    # a pair that meets in several blocks counts in the first
    apart = "bit_count(({0}) ^ ({1}))"
    first = f"forall(sequence(0, _b), b -> b = _b OR {apart.format(_block('_own_fp', 'b'), _block('_fp', 'b'))} > {BLOCK_RADIUS})"
    within = " + ".join(f"bit_count(_own_fp[{i}] ^ _fp[{i}])" for i in range(LONGS))
    near = near.where(f"{within} <= {RADIUS} AND {first}")
    near = near.withColumn("_both", F.size(F.array_intersect("_win", "_set")))
    similarity = F.col("_both") / (F.size("_win") + F.size("_set") - F.col("_both"))
    return near.select("doc_id", F.col("_key").alias("text_key"), "item_id", F.col("_start").alias("start_word"), (F.size("_win") + F.lit(k - 1)).alias("n_words"), similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def drop_contaminated(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """docs with the columns it has, without the documents that hold a benchmark item.

    Rows are known by id and text, so a null id does no harm; repeated rows go or stay together.
    Columns of any name come back as they are. Empty in, empty out.
    """
    p = fresh(docs)
    gone = cut(hits.select(F.col("doc_id").alias(p + "id"), F.col("text_key").alias(p + "of")).distinct())
    keyed = docs.withColumn(p + "key", F.xxhash64("text"))
    return keyed.join(small(gone, 32), F.col("doc_id").eqNullSafe(F.col(p + "id")) & (F.col(p + "key") == F.col(p + "of")), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
