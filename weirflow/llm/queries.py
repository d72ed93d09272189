"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, content_dedup, decontaminate, filter_audit, hilbert, licenses, order_minhash, packing, quality, secrets, simhash_tiles, timestamps, toxicity
from .session import table_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted", F.size("worst").alias("n_offending"))


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined_spans(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("spans")).alias("spans"), "n_live", "n_example",
    )


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.hilbert_shards(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op6_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))


def op8_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_dedup.content_sort_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op9_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "tokens")
    bitpack.write_tokens(_table(spark, sf_dir, "documents"), path)
    return bitpack.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_sweep_merge_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise(_table(spark, sf_dir, "stamps")).select("stamp_id", "utc_us", "rule", "ambiguous")


def op12_tiled_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_shapley_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_sum_of_squares_packing, op2_mil_toxicity, op3_license_rules, op4_secret_ownership, op5_hilbert_shards, op6_fourier_quality, op7_simhash_decontamination, op8_content_sort_dedup, op9_bit_packed_tokens, op10_order_minhash, op11_sweep_merge_timestamps, op12_tiled_simhash, op13_shapley_filter_audit)}

ORACLES = {
    "op8_content_sort_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    # the wall time's offset: those a day before and after, and whether each leads back to the wall time
    "op11_sweep_merge_timestamps": r"""
        WITH t AS (SELECT stamp_id, source, zone, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM stamps),
        m AS (SELECT *,
                regexp_extract(s, '^((20[0-9]{2})-([0-9]{2})-([0-9]{2})|(20[0-9]{2})([0-9]{2})([0-9]{2})|([0-9]{2})[.]([0-9]{2})[.](20[0-9]{2})|([0-9]{2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20[0-9]{2})|([0-9]{2})/([0-9]{2})/(20[0-9]{2}))(([T ])([0-9]{2}):([0-9]{2})(:([0-9]{2}))?( ?([AP]M))?( ?(Z|([+-])([0-9]{2}):?([0-9]{2})))?)?$',
                    ['whole', 'y1', 'm1', 'd1', 'y2', 'm2', 'd2', 'd3', 'm3', 'y3', 'd4', 'b4', 'y4', 'p5', 'q5', 'y5', 'time', 't', 'h', 'mi', 'x1', 'sec', 'x2', 'half', 'x3', 'off', 'sign', 'oh', 'om']) AS f
              FROM t),
        p AS (SELECT stamp_id, source, zone, s, f.whole <> '' AS shaped, f.p5 <> '' AS slashed, f.off AS off,
                CASE WHEN regexp_full_match(s, '[0-9]{10}') THEN s::BIGINT * 1000000 WHEN regexp_full_match(s, '[0-9]{13}') THEN s::BIGINT * 1000 END AS epoch,
                TRY_CAST(concat_ws('-', f.y1 || f.y2 || f.y3 || f.y4 || f.y5, f.m1 || f.m2 || f.m3 || CASE WHEN f.b4 <> '' THEN lpad(((instr('JanFebMarAprMayJunJulAugSepOctNovDec', f.b4) + 2) // 3)::VARCHAR, 2, '0') ELSE '' END, f.d1 || f.d2 || f.d3 || f.d4) AS DATE) AS own,
                TRY_CAST(concat_ws('-', f.y5, f.q5, f.p5) AS DATE) AS dmy, TRY_CAST(concat_ws('-', f.y5, f.p5, f.q5) AS DATE) AS mdy,
                CASE WHEN f.time = '' THEN 0
                     WHEN TRY_CAST(f.mi AS INT) > 59 OR (f.sec <> '' AND TRY_CAST(f.sec AS INT) > 59) THEN NULL
                     WHEN f.half = '' AND TRY_CAST(f.h AS INT) < 24 THEN TRY_CAST(f.h AS INT) * 3600
                     WHEN f.half <> '' AND TRY_CAST(f.h AS INT) BETWEEN 1 AND 12 THEN (TRY_CAST(f.h AS INT) % 12 + CASE f.half WHEN 'PM' THEN 12 ELSE 0 END) * 3600
                END + CASE WHEN f.time = '' THEN 0 ELSE TRY_CAST(f.mi AS INT) * 60 + CASE WHEN f.sec = '' THEN 0 ELSE TRY_CAST(f.sec AS INT) END END AS seconds,
                CASE WHEN f.off = 'Z' THEN 0 WHEN f.off <> '' AND TRY_CAST(f.oh AS INT) <= 14 AND TRY_CAST(f.om AS INT) <= 59 THEN (CASE f.sign WHEN '-' THEN -1 ELSE 1 END) * (TRY_CAST(f.oh AS INT) * 3600 + TRY_CAST(f.om AS INT) * 60) END AS shift
              FROM m),
        g AS (SELECT *, coalesce(shaped AND seconds IS NOT NULL AND (off = '' OR shift IS NOT NULL) AND (off <> '' OR zone IS NOT NULL) AND (own IS NOT NULL OR dmy IS NOT NULL OR mdy IS NOT NULL), false) AS good FROM p),
        v AS (SELECT source, count(*) FILTER (mdy IS NULL) AS n_dmy, count(*) FILTER (dmy IS NULL) AS n_mdy FROM g WHERE good AND slashed GROUP BY source),
        r AS (SELECT g.*, good AND slashed AND dmy <> mdy AS either, n_dmy, n_mdy FROM g LEFT JOIN v ON g.source IS NOT DISTINCT FROM v.source),
        w AS (SELECT *, CASE WHEN epoch IS NOT NULL THEN 'epoch' WHEN NOT good THEN 'bad' WHEN either AND n_dmy <> n_mdy THEN 'votes' WHEN either THEN 'default' ELSE 'plain' END AS rule,
                CASE WHEN good THEN epoch_us((CASE WHEN NOT slashed THEN own WHEN either AND n_mdy > n_dmy THEN mdy ELSE coalesce(dmy, mdy) END)::TIMESTAMP) // 1000000 + seconds END AS wall
              FROM r),
        o AS (SELECT *, epoch(timezone(zone, to_timestamp(wall - 86400)))::BIGINT - (wall - 86400) AS o1, epoch(timezone(zone, to_timestamp(wall + 86400)))::BIGINT - (wall + 86400) AS o2 FROM w),
        c AS (SELECT *, epoch(timezone(zone, to_timestamp(wall - o1)))::BIGINT = wall AS back1, epoch(timezone(zone, to_timestamp(wall - o2)))::BIGINT = wall AS back2 FROM o)
        SELECT stamp_id,
               CASE WHEN epoch IS NOT NULL THEN epoch WHEN shift IS NOT NULL THEN (wall - shift) * 1000000 WHEN back1 AND NOT back2 THEN (wall - o1) * 1000000 ELSE (wall - o2) * 1000000 END AS utc_us,
               rule,
               coalesce(rule IN ('votes', 'default') OR (rule <> 'epoch' AND shift IS NULL AND o1 <> o2 AND back1 = back2), false) AS ambiguous
        FROM c
    """,
    # every order is walked; the counts of masks are enough for that
    "op13_shapley_filter_audit": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
        f AS (SELECT doc_id, part,
                (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
                + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
        l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (SELECT '' AS path, 0 AS before, 0 AS bit, 0 AS step UNION ALL SELECT path || letter, o.before | o.bit, x.bit, step + 1 FROM o, x WHERE NOT contains(path, letter)),
        s AS (SELECT whole.path AS filter_order, o.step, o.before, o.bit FROM o JOIN o AS whole ON whole.step = 5 AND starts_with(whole.path, o.path) WHERE o.step > 0),
        k AS (SELECT part, filter_order, step, bit,
                coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
                coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
                coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
                coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
              FROM c, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM k
    """,
}
