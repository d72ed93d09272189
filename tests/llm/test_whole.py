"""Final results against brute force, very long texts in every operator, and the pipeline's edges."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.llm import bitpack, content_dedup, decontaminate, filter_audit, hilbert, licenses, order_minhash, packing, quality, secrets, simhash_tiles, toxicity
from weirflow.llm.tokens import default_path

SF = "/root/testdata/sf0.001"


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


# licenses


def _left_of(found):
    """Detections without those inside another (of equal ones the first rule), then in the order of the rules those that overlap none that stays; by all pairs."""
    inside = lambda d, e: e[0] <= d[0] and d[1] <= e[1] and ((e[0], e[1]) != (d[0], d[1]) or e[2].priority < d[2].priority)
    outer = [d for d in found if not any(inside(d, e) for e in found if e is not d)]
    stay = []
    for d in sorted(outer, key=lambda d: (d[2].priority, d[0])):
        if all(d[1] <= e[0] or e[1] <= d[0] for e in stay):
            stay.append(d)
    return stay


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8), st.integers(0, 6)), max_size=14))
def test_suppression_of_all_pairs(spans):
    rules = [licenses.Rule(i, f"l{i}", (), re.compile(b"x"), 1.0) for i in range(7)]
    found = [(a, a + n, rules[p]) for a, n, p in {(a, n, p): 0 for a, n, p in spans}]
    got = sorted((a, b, r.priority) for a, b, r in licenses.suppressed(found))
    assert got == sorted((a, b, r.priority) for a, b, r in _left_of(found))


def test_license_labels_of_all_rules(spark, documents):
    """Labels, places and scores of every rule on every text, without the keywords' gate."""
    pieces = ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: GPL-2.0-or-later", "all rights reserved", "the mit license", "released under the GNU General Public License v3", "creative commons attribution", "free text", "CC BY NC", "bsd 3 clause license", "no part of this book may be reproduced", "permission is hereby granted, free of charge, to any person"]
    rng = random.Random(1)
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(80)] + [r.text for r in documents.where("text RLIKE '(?i)licen|mit |rights|cc'").limit(60).collect()]
    got = {r.doc_id: r for r in licenses.scan_licenses(_frame(spark, texts)).collect()}
    ordered, some = licenses.rules(), 0
    for i, text in enumerate(texts):
        words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
        joined = b" ".join(words)
        found = [(m.start(), m.end(), r) for r in ordered for m in r.pattern.finditer(joined)]
        stay = _left_of(found)
        word = lambda at, joined=joined: joined[:at].count(b" ")
        spans = sorted((r.label, word(a), word(b - 1) - word(a) + 1, r.score) for a, b, r in stay)
        assert sorted(map(tuple, got[i].spans)) == spans
        base = set(filter(None, got[i].base_labels.split(",")))
        assert got[i].labels == ",".join(sorted(base | {s[0] for s in spans}))
        assert got[i].score == max([s[3] for s in spans], default=0.9 if base else 0.0)
        some += len(found) > len(stay)
    assert some > 10


# trained scores


def test_toxic_scores_are_noisy_or_of_sentences(spark):
    """A text's score is that of its sentences scored one by one; with a trained model."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = [r.text for r in docs.limit(25).collect()]
    ends = re.compile("[" + re.escape("".join(chr(b) for b in np.flatnonzero(toxicity._BREAK) if b < 128)) + "]")
    parts = [ends.split(t) for t in texts]
    flat = [p for own in parts for p in own]
    single = {r.doc_id: r.score for r in toxicity.score(_frame(spark, flat), model).collect()}
    whole = {r.doc_id: r.score for r in toxicity.score(_frame(spark, texts), model).collect()}
    at = 0
    for i, own in enumerate(parts):
        clean = np.prod([1 - single[at + j] for j in range(len(own))])
        assert whole[i] == pytest.approx(1 - clean, abs=1e-9)
        at += len(own)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 1)), min_size=1, max_size=30))
def test_isotonic_levels(rows):
    """A level is the largest over starts of the least over ends of the mean between, pulled towards a half by its pool's size, and never below the one before."""
    rows = sorted(rows)
    x, y = np.array([r[0] for r in rows], float) + np.arange(len(rows)) * 1e-6, np.array([r[1] for r in rows], float)
    knots, levels = quality.isotonic(x, y)
    mean = lambda a, b: y[a : b + 1].mean()
    fit = np.array([max(min(mean(a, b) for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))])
    pools = [np.isclose(fit, v) for v in fit]
    want = np.maximum.accumulate([(y[pool].sum() + 0.5) / (pool.sum() + 1) for pool in pools])  # a small pool's pull mustn't turn the order
    assert np.interp(x, knots, levels) == pytest.approx(want)


def test_quality_scores_from_the_model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    texts = [r.text for r in docs.limit(40).collect()]
    import pyarrow as pa

    stats = quality.statistics(pa.array(texts))
    z = (np.asarray(stats) - model.mean) / model.scale
    got = {r.doc_id: r.score for r in quality.score(_frame(spark, texts), model).collect()}
    raw = model.features(np.asarray(stats)) @ model.weights
    assert np.isfinite(z).all()
    for i in range(len(texts)):
        level = np.interp(raw[i], model.knots, model.levels)
        assert got[i] == pytest.approx(min(1.0, 0.98 * level + 0.02 / (1 + np.exp(-4 * (raw[i] - 0.5)))))


# secrets


def test_verdicts_by_owners(spark):
    """Spans of added kinds are those whose value looks random and stands with fewer than three owners, counted by plain sets."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    values = ["ghp_" + "".join(rng.choice(letters) for _ in range(36)) for _ in range(12)] + ["ghp_" + "a" * 36, "xoxb-1111111111-aaaaaaaa", "AIza" + "".join(rng.choice(letters) for _ in range(35))]
    rows = []
    for i in range(120):
        mine = rng.sample(values, rng.randrange(0, 4))
        rows.append((i, "é " + " and ".join(mine) + " end", "en", rng.choice([None, "a", "b", "c", "d"]) if i % 3 else "a"))
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    owners = {v: {s for _, t, _, s in rows if v in t} for v in values}

    def random_looking(v):
        return len(set(v)) >= min(10, len(v) / 2) and re.search("[0-9]", v) and not re.search("(?i)example|changeme|placeholder|your|dummy|xxxx|1234567", v)

    live = {v for v in values if random_looking(v) and len(owners[v]) < 3}
    for i, text, _, _ in rows:
        want = sorted((m.start(), m.end()) for v in live for m in re.finditer(re.escape(v), text))
        assert sorted((s.start, s.end) for s in got[i].spans if not s.base) == want
    assert 0 < len(live) < len(values)


# very long texts


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(3)
    words = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    return [" ".join(words), " ".join([*words[:19_990], *"ten other words stand here at the very end now".split()]), "short", " ".join(["same"] * 20_000), "x" * 300_000]


def test_every_operator_takes_very_long_texts(spark, long_texts, tmp_path):
    from tokenizers import Tokenizer

    df = _frame(spark, long_texts)
    n = len(long_texts)
    plain = [Tokenizer.from_file(default_path("word_bpe_49k.json")).encode(t, add_special_tokens=False).ids for t in long_texts]
    packed = packing.pack(df).collect()
    for i in range(n):
        own = sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == [*plain[i], 1]
    found = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [found[i].n_words for i in range(n)] == [len(t.split()) for t in long_texts]
    assert secrets.scan_secrets(df).count() == n and hilbert.hilbert_shards(df, shards=2).count() == n
    model = toxicity.train(df, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"), modulus=7, remainder=6)
    assert toxicity.score(df, model).count() == n
    marks = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score(df, quality.train(df, marks)).collect())
    bench = spark.createDataFrame([(1, " ".join(long_texts[0].split()[12_000:12_040]))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminate(df, bench).collect()} == {0, 1}
    assert content_dedup.content_sort_dedup(df).where("kept").count() == n
    path = f"file://{tmp_path}/tokens"
    bitpack.write_tokens(df, path)
    byte = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    for r in bitpack.read_tokens(spark, path).collect():
        assert zlib.crc32(r.ids) == zlib.crc32(np.array([*byte.encode(long_texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4").tobytes())
    near = {r.doc_id: r for r in order_minhash.near_duplicates(df).collect()}
    assert len(near) == n and len({tuple(near[i][1:2]) for i in (0, 1)}) == 1
    assert Counter(r.doc_id for r in simhash_tiles.near_duplicates(df).collect()) == Counter(range(n))
    assert filter_audit.filter_audit(df, marks.selectExpr("doc_id", "quality", "0 AS toxic")).count() == 600 * 3


# the pipeline


def _tables(spark, folder, docs, labels, bench):
    docs.write.parquet(f"file://{folder}/documents.parquet")
    labels.write.parquet(f"file://{folder}/labels.parquet")
    bench.write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}"


def test_pipeline_on_empty_and_null_tables(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (2, None, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, "one two three four five six")], "item_id long, text string")
    schema = "doc_id long, text string, lang string, source string"
    none = _tables(spark, tmp_path / "none", spark.createDataFrame([], schema), labels.limit(0), bench.limit(0))
    assert corpus_pipeline.run(spark, none).count() == 0
    rows = [(1, None, None, None), (2, "", "en", None), (None, None, None, None), (3, "a clean text", None, "s"), (3, "a clean text", None, "s"), (None, "another text of its own", "en", "s")]
    odd = _tables(spark, tmp_path / "odd", spark.createDataFrame(rows, schema), labels, bench)
    out = corpus_pipeline.run(spark, odd).collect()
    # one of the empty texts, one of the equal ones, and the one without an id
    assert Counter(r.doc_id for r in out) == {1: 1, 3: 1, None: 1}


def test_pipeline_drops_what_each_stage_should(spark, tmp_path):
    """Planted cases on clean texts: an exact copy, a near copy, a benchmark passage, and a toxic text as the labels mark it; everything else stays."""
    import corpus_pipeline

    rng = random.Random(4)
    text = lambda n=60: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, text()) for i in range(200)]
    rows += [(1000 + i, f"{text(20)}. you vile{i % 3} wretch. {text(20)}") for i in range(60)]
    base = text(200)
    near = base.split()
    near[100] = "changed"
    passage = text(40)
    rows += [(300, rows[0][1]), (301, base), (302, " ".join(near)), (303, f"{text(30)} {passage} {text(30)}")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in rows if i < 200 or i >= 1000], "doc_id long, quality int, toxic int")
    sf = _tables(spark, tmp_path / "in", docs, labels, spark.createDataFrame([(7, passage)], "item_id long, text string"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert kept == {*range(200), 301}
