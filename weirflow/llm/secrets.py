"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Every candidate's value is hashed; the hashes are aggregated over the corpus by distinct
repositories and owners. A value that many owners carry is a copied example; one that stays with
few owners and looks random is reported as live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut, lookup

#: Kinds of the base scan in their order: pattern, group of the value, least length of that group, a test that is cheap and never wrong.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20, "AKIA"),
    ("hex", r"([0-9a-f]{24,})", 1, 24, "[0-9a-f]{24}"),
)
#: Kinds that the ownership method may add.
EXTRA = (
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 28, "eyJ"),
    ("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40, "gh[pousr]_"),
    ("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 15, "xox[abprs]-"),
    ("google", r"(AIza[0-9A-Za-z_-]{35})", 1, 39, "AIza"),
    ("stripe", r"([sr]k_live_[0-9A-Za-z]{16,})", 1, 24, "k_live_"),
    ("pem", r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,})", 1, 40, "PRIVATE KEY-----"),
    ("url", r"([a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@)", 1, 8, "://"),
)
SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int,hash:string,random:boolean,base:boolean>>"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(number: int, kind: str, pattern: str, group: int, least: int, gate: str, base: bool) -> Column:
    """Leftmost non-overlapping matches in `_text` whose group is long enough, with code-point offsets.

    Spark gives the matches but not their places: the pieces between matches have the rest of the lengths.
    """
    plain = gate.isascii() and not any(c in gate for c in "[](){}?*+|\\.")
    test = f"contains(_text, {_sql(gate)})" if plain else f"_text RLIKE {_sql(gate)}"
    if "[:=]" in gate:
        test = f"(contains(_text, ':') OR contains(_text, '=')) AND {test}"
    p = _sql(pattern)
    found = f"transform(arrays_zip(regexp_extract_all(_text, {p}, 0), regexp_extract_all(_text, {p}, {group}), slice(split(_text, {p}), 1, size(regexp_extract_all(_text, {p}, 0)))), z -> named_struct('whole', z['0'], 'own', z['1'], 'gap', length(z['2'])))"
    placed = (
        f"aggregate({found}, named_struct('at', 0, 'out', CAST(array() AS {SPAN})), (a, m) -> named_struct('at', a.at + m.gap + length(m.whole), 'out', "
        f"IF(length(m.own) >= {least}, array_append(a.out, named_struct('start', a.at + m.gap, 'kind_no', {number}, 'kind', '{kind}', 'end', a.at + m.gap + length(m.whole), "
        f"'hash', sha2(m.own, 256), 'random', {_random('m.own')}, 'base', {str(base).lower()})), a.out)), a -> a.out)"
    )
    return F.expr(f"IF({test}, {placed}, CAST(array() AS {SPAN}))")


def _random(value: str) -> str:
    """Looks random: half of its characters differ or 10 do, and it holds digits; no dictionary placeholder."""
    kinds = f"size(array_distinct(split({value}, '')))"
    return f"({kinds} >= least(10, length({value}) / 2.0) AND {value} RLIKE '[0-9]' AND NOT {value} RLIKE '(?i)example|changeme|placeholder|your|dummy|xxxx|1234567')"


def scan_secrets(docs: DataFrame, *, owner_col: str = "source", repo_col: str = "doc_id", example_owners: int = 3, example_repos: int | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_assign, n_access, n_hex, base_spans, spans, n_live, n_example.

    base_spans and spans are arrays of (start, kind_no, kind, end, hash, verdict), ordered by start,
    then kind; offsets are code points. Base spans always stay. A span of an extra kind is added
    if its value is live: carried by fewer than example_owners owners, in any number of
    repositories (owner, repo) unless example_repos limits it to fewer than that, and random to
    look at. Everything else is an example.
    A null text counts as empty; null owners or repositories count as one of their own; rows with
    the same id and text have the same result. Other columns are not looked at.
    """
    kinds = [*((i, *k, True) for i, k in enumerate(BASE)), *((i + len(BASE), *k, False) for i, k in enumerate(EXTRA))]
    text = docs.select("doc_id", F.col(owner_col).cast("string").alias("_owner"), F.col(repo_col).cast("string").alias("_repo"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    scanned = text.select("doc_id", "_owner", "_repo", F.xxhash64("_text").alias("_key"), *[_spans(*k).alias(f"_k{k[0]}") for k in kinds])
    all_kinds = [F.col(f"_k{k[0]}") for k in kinds]
    scanned = cut(scanned.select(
        "doc_id", "_owner", "_repo", "_key",
        *[F.size(f"_k{i}").cast("long").alias(f"n_{k[0]}") for i, k in enumerate(BASE)],
        F.array_sort(F.concat(*all_kinds)).alias("_found"),
    ))
    with_any = scanned.where(F.size("_found") > 0)
    found = with_any.select("doc_id", "_owner", "_repo", "_key", F.explode("_found").alias("_span"))
    # counts before joins: each hash comes down to one row, however many documents carry it
    pairs = found.select(F.col("_span.hash").alias("_hash"), F.coalesce("_owner", F.lit("\0")).alias("_owner"), F.coalesce("_repo", F.lit("\0")).alias("_repo"))
    pairs = pairs.groupBy("_hash", "_owner", "_repo").agg(F.count(F.lit(1)).alias("_times"))
    by_owner = pairs.groupBy("_hash", "_owner").agg(F.count(F.lit(1)).alias("_repos"), F.sum("_times").alias("_times"))
    owners = by_owner.groupBy("_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("_repos").alias("repos"), F.sum("_times").alias("_times"))
    # a widely copied value's spans are dealt over tasks
    judged = lookup(found.withColumn("_hash", F.col("_span.hash")), owners, ["_hash"], "_times", row_bytes=120)
    live = (F.col("owners") < example_owners) & F.col("_span.random")
    if example_repos is not None:
        live &= F.col("repos") < example_repos
    span = F.struct("_span.start", "_span.kind_no", "_span.kind", "_span.end", "_span.hash", "_span.base", live.alias("live"), "owners", "repos")
    by_doc = judged.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set(span)).alias("_spans")).withColumnsRenamed({"doc_id": "_id", "_key": "_own_key"})
    joined = with_any.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_own_key")))
    counts = [f"n_{k[0]}" for k in BASE]
    empty = by_doc.schema["_spans"].dataType
    out = joined.select("doc_id", *counts, "_spans").unionByName(
        scanned.where(F.size("_found") == 0).select("doc_id", *counts, F.array().cast(empty).alias("_spans"))
    )
    kept = F.filter("_spans", lambda s: s["base"] | s["live"])
    return out.select(
        "doc_id", *counts,
        F.filter("_spans", lambda s: s["base"]).alias("base_spans"), kept.alias("spans"),
        F.size(F.filter("_spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("_spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
