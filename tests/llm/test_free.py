import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow import storage
from weirflow.llm import bitpack, components, licenses, order_minhash, packing, quality, queries, session, textbytes, toxicity
from weirflow.llm.tokens import Encoder, default_path

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "a b", "a  b\n c", "\n", " x", "a\tb", "it's don't  ", "é ̈ x", "a b c", "x\n\ny z", "Word, word. WORD! É.", "İstanbul ǅ ﬁ", None, "ab### cd%%%\nEf. <|endoftext|>. x<|endoftext|>\ny", "a\u3000b", "a\x1fb", "1st... 2²! x'. 's", "a \nb", "\na b", "İ# \u0958, x"]


@pytest.mark.parametrize("name,joins", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_ids_are_the_library_s(documents, name, joins):
    from tokenizers import Tokenizer

    texts = [r.text or "" for r in documents.select("text").limit(60).collect()] + TEXTS
    plain = Tokenizer.from_file(default_path(name))
    encoder = Encoder(default_path(name), joins, cached_words=500)
    for _ in range(2):
        got = encoder.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_sum_of_squares_places_everything_once(sizes):
    stream = packing.SumOfSquares(64, max_open=6)
    windows = [w for i, n in enumerate(sizes) for w in stream.place([i, 0, n])] + stream.close()
    assert all(sum(p[2] for p in w) <= 64 for w in windows) and sum(sum(p[2] for p in w) < 64 for w in windows) <= 1
    spots = sorted((row, start + j) for w in windows for row, start, n in w for j in range(n))
    assert spots == [(i, j) for i, n in enumerate(sizes) for j in range(n)]


def _least_squares_of_counts(size, pieces):
    """The level that each piece goes to, by the sum of the squared counts of every choice; of equal ones the fullest, a new window last."""
    open_, choices = Counter(), []
    for n in pieces:
        best = None
        for level in [*sorted((k for k in open_ if open_[k] and k + n <= size), reverse=True), 0]:
            after = open_.copy()
            after[level] -= level > 0
            after[level + n] += level + n < size
            cost = sum(c * c for c in after.values())
            if best is None or cost < best[0]:
                best = (cost, level, after)
        _, level, open_ = best
        choices.append(level)
    return choices


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 23), max_size=60))
def test_pieces_go_where_the_squares_are_least(sizes):
    class Spy(packing.SumOfSquares):
        def _take(self, level):
            chosen.append(level)
            return super()._take(level)

    stream, got = Spy(24), []
    for i, n in enumerate(sizes):
        chosen = []
        stream.place([i, 0, n])
        got.append(chosen[0] if chosen else 0)
    assert got == _least_squares_of_counts(24, sizes)


def test_packed_pieces(odd, nothing):
    rows = packing.pack(odd, window=16).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 16
    encoder = Encoder(default_path("word_bpe_49k.json"), False)
    for d, text in ((7, odd.where("doc_id = 7").first().text), (3, "")):
        got = b"".join(bytes(r.ids) for r in sorted(by_doc[d], key=lambda r: r.start))
        assert got == encoder.encode([text])[0] + b"\1\0\0\0"
    assert len(by_doc[4]) == 2 and packing.pack(nothing).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.integers(0, 70), st.integers(0, 70))
def test_bit_packing_round_trip(bits, ids, a, b):
    own = [i & ((1 << bits) - 1) for i in ids]
    documents = [np.array(own[:10], "<u4").tobytes(), np.array(own[10:], "<u4").tobytes()]
    s = bitpack.Segment(bitpack.write_segment([None, 7], documents, bits, block_ids=9))
    assert s.ids().tolist() == own and s.ids(a, b).tolist() == own[a:b] and s.doc_ids == [None, 7]


def test_token_files(spark, odd, nothing, documents):
    for df in (odd, nothing, documents):
        path = session.table_path(spark, "test-tokens")
        bitpack.write_tokens(df, path, segment_ids=200)
        rows = sorted(bitpack.read_tokens(spark, path).collect(), key=lambda r: r.start)
        docs = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
        assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
        at, encoder = 0, Encoder(default_path("byte_bpe_50k.json"), True)
        for r, d in zip(rows, docs, strict=True):
            expected = encoder.encode([d.text or ""])[0] + b"\0\0\0\0"
            assert r.start == at and r.n_tokens == len(expected) // 4 and zlib.crc32(bytes(r.ids)) == zlib.crc32(expected)
            at += r.n_tokens


def test_one_document_is_fetched(spark, odd):
    path = session.table_path(spark, "test-tokens")
    bitpack.write_tokens(odd, path, segment_ids=40)
    whole = {(r.doc_id, r.n_tokens, bytes(r.ids)) for r in bitpack.read_tokens(spark, path).collect()}
    got = [(r.doc_id, r.n_tokens, bytes(r.ids)) for r in bitpack.fetch_tokens(spark, path, [7, 4, 77]).collect()]
    assert sorted(d for d, *_ in got) == [4, 4, 7] and set(got) <= whole
    assert bitpack.fetch_tokens(spark, path, []).count() == 0


def test_many_documents_are_fetched(spark, tmp_path):
    """Thousands of ids in far apart runs come from a bounded plan; the vocabulary's size is the file's."""
    df = spark.range(6000).selectExpr("id * 7 AS doc_id", "concat('text ', id % 50) AS text")
    path = f"file://{tmp_path}/tokens"
    bitpack.write_tokens(df, path, segment_ids=500)
    ids = [*range(0, 7000, 2), 35_000, 41_993, 10**9]
    got = [r.doc_id for r in bitpack.fetch_tokens(spark, path, ids).collect()]
    assert sorted(got) == sorted(i for i in ids if i % 7 == 0 and i < 42_000)
    assert bitpack._ranges([1, 2, 3, 10, 11, 50], 3) == [(1, 3), (10, 11), (50, 50)] and bitpack._ranges([4], 3) == [(4, 4)]
    assert bitpack.vocabulary_size(default_path("byte_bpe_50k.json")) == 50257


def test_license_places(odd, documents, nothing):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    columns = ["doc_id", "text"]
    for df in (odd, documents):
        rows = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(df).collect()}
        for d in df.select(*columns).collect():
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (d.text or "").translate(low))
            places, labels = [], set()
            for phrase, label in licenses.BASE:
                q = phrase.split()
                hits = [i for i in range(len(w)) if w[i : i + len(q)] == q]
                places += hits
                labels |= {label} if hits else set()
            r = rows[d.doc_id, len(w)]
            assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
            assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licenses(nothing).count() == 0 and len(licenses.rules()) > 200


def _alternatives(parts):
    """An example of every alternative of a parsed pattern; of a set of characters the first."""
    out = [""]
    for op, v in parts:
        match str(op):
            case "LITERAL":
                own = [chr(v)]
            case "IN":
                kind, x = v[0]
                own = [chr(x) if str(kind) == "LITERAL" else chr(x[0]) if str(kind) == "RANGE" else "w"]
            case "ANY":
                own = ["x"]
            case "BRANCH":
                own = [e for branch in v[1] for e in _alternatives(branch)]
            case "SUBPATTERN":
                own = _alternatives(v[3])
            case "MAX_REPEAT" | "MIN_REPEAT":
                own = [""] * (v[0] == 0) + _alternatives(v[2])
            case _:
                continue
        out = [a + b for a in out for b in own]
    return out


def test_every_alternative_of_a_license_rule_passes_its_keywords(spark):
    missed = set()
    for rule in licenses.rules():
        for text in map(str.encode, _alternatives(re._parser.parse(rule.pattern.pattern.decode()))):
            assert rule.pattern.fullmatch(text)
            if not set(rule.keywords) & set(text.split()):
                missed.add((rule.label, text))
    assert not missed
    texts = {"licensed under the gplv2": "gpl-2.0", "released under lgplv3": "lgpl-3.0", "distributed under FreeBSD license": "bsd-2-clause", "license 0BSD": "0bsd", "licensed under the SIL Open Font License version 1.1": "ofl-1.1", "the universal permissive license license": "upl-1.0", "public domain dedication and license license": "pddl-1.0", "license: MPL-1.1": "mpl-1.1"}
    found = licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "text string, label string").selectExpr("monotonically_increasing_id() AS doc_id", "text"))
    assert sorted(r.labels for r in found.collect()) == sorted(texts.values())


def test_contained_detections_are_suppressed():
    rules = licenses.rules()
    found = [(0, 10, rules[5]), (2, 8, rules[0]), (0, 10, rules[2]), (5, 15, rules[9])]
    assert licenses.suppressed(found) == [(0, 10, rules[2])]
    assert licenses.suppressed([(0, 10, rules[7]), (10, 15, rules[9]), (5, 9, rules[1]), (12, 20, rules[3])]) == [(0, 10, rules[7]), (12, 20, rules[3])]


def test_toxicity(spark, odd, nothing):
    bad = ["vile", "awful"]
    rows = [(i, f"some plain words here. and w{i % 7} {bad[i % 4] if i % 4 < 2 else 'kind'} more. the end w{i % 5}", int(i % 4 < 2)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scored = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(scored[i].predicted == y and scored[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, y in rows)
    worst = scored[0].worst[0]
    assert rows[0][1].encode()[worst.start : worst.end].decode() == "and w0 vile more"
    found = toxicity.score(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score(nothing, model).count() == 0 and toxicity.drop_toxic(odd, model).count() == odd.count()
    assert toxicity.drop_toxic(docs, model).count() == sum(1 - y for *_, y in rows)
    one_sided = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, one_sided).collect()} == {0}


def test_sample_is_bounded_and_whole(spark):
    from pyspark.sql import functions as F

    from weirflow.llm.labelled import sample

    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, 1), (1, None)], "doc_id long, toxic int")
    rows = sample(docs, labels, "toxic", F.lit(False), 10).collect()
    assert sorted((r.doc_id, r.y, r.text in ("a", "b", "")) for r in rows) == [(1, 1.0, True), (2, 0.0, True)]
    assert len(sample(docs, labels, "toxic", F.lit(False), 1).collect()) <= 1


def test_noisy_or_gradient():
    rng = np.random.default_rng(0)
    n_sent, n_terms = 40, 6
    sent = np.sort(rng.integers(0, n_sent, 90))
    bags = toxicity.Bags(rng.integers(0, n_terms, 90), sent, rng.integers(1, 4, n_sent).astype(float), np.sort(rng.integers(0, 12, n_sent)), rng.integers(0, 2, 12).astype(float))
    w, bias = rng.normal(size=n_terms), -1.3
    _, by_weight, by_bias = toxicity.gradient(bags, w, bias)

    def loss(w, bias):
        total = 0.0
        for d in range(12):
            clean = 1.0
            for j in np.flatnonzero(bags.text_of == d):
                clean *= (1 - 1 / (1 + np.exp(-(bias + w[bags.terms[bags.sentence_of == j]].sum())))) ** bags.times[j]
            total -= np.log(max(1 - clean, 1e-9)) if bags.y[d] else np.log(clean)
        return total / 12

    assert toxicity.gradient(bags, w, bias)[0] == pytest.approx(loss(w, bias))
    for j in range(n_terms):
        step = np.eye(n_terms)[j] * 1e-5
        assert by_weight[j] == pytest.approx((loss(w + step, bias) - loss(w - step, bias)) / 2e-5, abs=1e-6)
    held = np.isin(np.arange(12), bags.text_of)  # a text without sentences has no slope
    assert held.any() and by_bias == pytest.approx((loss(w, bias + 1e-5) - loss(w, bias - 1e-5)) / 2e-5, abs=1e-6)


def test_bags_are_the_sentences(spark):
    rows = [(1, 1.0, "vile day. kind day. vile day! kind"), (2, 0.0, None), (3, 0.0, "kind. kind."), (4, 1.0, "vile vile")]
    df = spark.createDataFrame(rows, "doc_id long, y double, text string").repartition(3)
    vile = textbytes.Words(np.frombuffer(b"vile", np.uint8), np.array([0, 4])).hashes()
    bags = toxicity._bags(df, vile)
    found = sorted((int(bags.text_of[j]), int((bags.sentence_of == j).sum()), int(bags.times[j])) for j in range(len(bags.times)))
    assert found == [(0, 0, 2), (0, 1, 2), (2, 0, 2), (3, 2, 1)] and bags.y.tolist() == [1, 0, 0, 1]
    assert vile[0] in toxicity._useful(df, 2)


def test_all_offending_sentences_are_reported(spark):
    data = np.frombuffer(b"vile", np.uint8)
    model = toxicity.Model(textbytes.Words(data, np.array([0, 4])).hashes(), np.array([9.0]), -4.0, 0.5)
    many = spark.createDataFrame([(1, "a vile day. all kind here. " * 7)], "doc_id long, text string")
    assert [len(toxicity.score(many, model, **top).first().worst) for top in ({}, {"top": 3})] == [7, 3]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for query, target, least in ((queries.op2_mil_toxicity, "toxic", 0.9), (queries.op6_fourier_quality, "quality", 0.95)):
        rows = query(spark, sf).where("held_out").join(labels, "doc_id").collect()
        assert sum(r.predicted == r[target] for r in rows) >= least * len(rows)


def test_quality_edges(spark, odd, nothing):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and quality.score(nothing, model).count() == 0
    assert quality.score(odd, quality.train(docs, labels.limit(0))).count() == odd.count()
    knots, levels = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(levels) >= 0).all() and len(knots) == 6


def test_fourier_features_and_normal_equations(spark):
    rng = np.random.default_rng(1)
    d, n = 4000, quality.N_STATS
    model = quality.Model(np.zeros(n), np.ones(n), rng.normal(size=(n, d)) / 3.0, rng.uniform(0, 2 * np.pi, d), *[np.zeros(0)] * 3)
    x = rng.normal(size=(30, n)) * 0.7
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 3.0**2))
    assert np.abs(z @ z.T - kernel).max() < 0.1
    small = quality.Model(np.zeros(n), np.ones(n), model.omega[:, :20], model.phase[:20], *[np.zeros(0)] * 3)
    y = rng.integers(0, 2, 30).astype(float)
    df = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(y, x, strict=True)], "y double, stats array<double>").repartition(4)
    gram, right = quality._sums(df, small, 3)
    f = small.features(x)
    assert np.allclose(gram, f.T @ f) and np.allclose(right, f.T @ y)


def _alignment(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    s = table[-1, -1]
    return s / (len(a) + len(b) - s)


@settings(max_examples=80, deadline=None)
@given(st.permutations(range(24)), st.integers(0, 5), st.integers(0, 23))
def test_alignment_against_dynamic_programming(order, moves, cut):
    a = list(range(24))
    b = a[:cut] + order[:moves] + a[cut:] if moves else a[:cut] + a[cut + 2 :]
    b = list(dict.fromkeys(b))
    if not b:
        return
    exact = _alignment(a, b)
    got = order_minhash.alignment_similarity(np.array(a, "<u4"), np.array(b, "<u4"), 0.8)
    assert got == pytest.approx(exact) if exact >= 0.8 else got < 0.8


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (5, 5), (4, 1)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    more = [(4, 8), (20, 21), (5, 20), (1, 3)]
    both = dict(map(tuple, components.components(spark.createDataFrame(links + more, "a long, b long")).collect()))
    first = components.components(spark.createDataFrame(links, "a long, b long"))
    assert dict(map(tuple, components.joined(first, spark.createDataFrame(more, "a long, b long")).collect())) == both


def test_lookup_deals_hot_keys_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    left = spark.range(1000).selectExpr("IF(id < 600, 0, id) AS k", "id")
    right = left.groupBy("k").count().selectExpr("k", "k * 2 AS v", "`count` AS n").where("k <> 700")
    rows = session.lookup(left, right, ["k"], "n").collect()
    assert len(rows) == 999 and all(r.v == 2 * r.k for r in rows)
    assert session.lookup(left, right, ["k"], "n", "left").where("v IS NULL").count() == 1
    links = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(500, 501)], "a long, b long")
    assert {tuple(r) for r in components.components(links).collect()} == {(i, 0) for i in range(300)} | {(500, 500), (501, 500)}


def test_near_duplicates_against_brute_force(spark, odd, nothing, documents):
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in rng.integers(0, 10**6, 120)]
    chain = [(1000 + i, " ".join(base[2 * i : 2 * i + 100])) for i in range(6)]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(chain, "doc_id long, text string"))
    rows = {r.doc_id: r for r in order_minhash.near_duplicates(df).collect()}
    texts = {r.doc_id: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in df.collect()}
    grams = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in texts.items()}
    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(grams[a] & grams[b])
        if both and both / len(grams[a] | grams[b]) >= 0.82:
            assert rows[a].class_id == rows[b].class_id
        if rows[a].class_id == rows[b].class_id:
            assert both
    assert {rows[1000 + i].class_id for i in range(6)} == {1000}
    found = order_minhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r.class_id for r in found}
    assert by[1] == by[2] == 1 and by[3] == by[4] == 3 and by[5] == 5 and by[None] is None
    assert order_minhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("broadcast", [0, storage.BROADCAST_BYTES])
def test_a_document_in_many_pairs_is_dealt_over_tasks(spark, monkeypatch, broadcast):
    """One document at either end of most pairs; id 7 has two texts, so each of its pairs is aligned twice."""
    base = [f"u{i}" for i in range(60)]
    texts = [(i, " ".join(base[: 60 - i % 20])) for i in range(80)] + [(7, " ".join(base))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pairs = storage.cut(spark.createDataFrame([(0, i) for i in range(1, 80)] + [(i, 79) for i in range(1, 79)] + [(3, 5)], "a long, b long"))
    once = {tuple(r) for r in order_minhash._verified(pairs, docs, 5, 0.8).collect()}
    assert order_minhash._hot_ends(pairs, "a").isEmpty()
    monkeypatch.setattr(order_minhash, "TASK_ROWS", 8)
    monkeypatch.setattr(storage, "BROADCAST_BYTES", broadcast)
    assert {tuple(r) for r in order_minhash._hot_ends(pairs, "a").collect()} == {(0, 10)}
    assert {tuple(r) for r in order_minhash._hot_ends(pairs, "b").collect()} == {(79, 10)}
    assert {tuple(r) for r in order_minhash._verified(pairs, docs, 5, 0.8).collect()} == once
    sizes = {i: {len(t.split()) - 4 for d, t in texts if d == i} for i in range(80)}
    assert once == {(a, b) for a, b in map(tuple, pairs.collect()) if any(min(x, y) / max(x, y) >= 0.8 for x in sizes[a] for y in sizes[b])}


def test_classes_are_the_components_of_all_links(spark, documents):
    """Every pair of documents that shares a k-mer is aligned: the same classes, so neither a missed link nor a false merge."""
    words = lambda t: textbytes.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])).hashes()
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(150)]
    more = []
    for i in range(120):
        own = list(base)
        at, n = rng.integers(0, 140), rng.integers(1, 22)
        own[at : at + n] = [f"n{i}x{j}" for j in range(n)]
        more.append((2000 + i, " ".join(own)))
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(df).collect()}
    kmers = {r.doc_id: textbytes.labelled(textbytes.shingles(words(r.text or ""), 5)).astype("<u4") for r in df.collect()}
    sets, texts = {d: set(k.tolist()) for d, k in kmers.items()}, {r.doc_id: r.text or "" for r in df.collect()}
    parent = {d: d for d in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(rows), 2):
        same = kmers[a].tolist() == kmers[b].tolist() if len(kmers[a]) else texts[a] == texts[b]
        if same or (sets[a] & sets[b] and order_minhash.alignment_similarity(kmers[a], kmers[b], 0.8) >= 0.8):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert rows == {d: root(d) for d in rows}


def test_single_link_in_a_group_below_the_threshold(spark):
    """Form letters at 0.77 to each other and one pair at 0.85, which shares no bucket's ends."""
    rng = np.random.default_rng(5)
    form, own = [f"t5x{i}" for i in range(400)], [[f"g5d{d}w{i}" for i in range(47)] for d in range(300)]
    a, b = (int(x) for x in rng.choice(np.arange(5, 295), 2, replace=False))
    own[b][:18] = own[a][:18]
    letters = spark.createDataFrame([(1500 + d, " ".join(form[:180] + own[d] + form[227:])) for d in range(300)], "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(letters).collect()}
    assert classes == {i: i for i in range(1500, 1800)} | {1500 + max(a, b): 1500 + min(a, b)}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
            path = session.table_path(spark, "test-stage")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_runs_its_stages_in_order(spark, monkeypatch):
    import corpus_pipeline

    def stage(least):
        return lambda spark, docs, sf_dir: docs.where(f"doc_id >= {least} AND '{sf_dir}' = '{SF}'")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage(3)), ("b", stage(7)), ("c", lambda spark, docs, sf_dir: docs.select("doc_id"))])
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id"] and found.agg({"doc_id": "min"}).first()[0] == 7
    assert [n for n, _ in corpus_pipeline.STAGES] == ["a", "b", "c"] and "/b-" in found.inputFiles()[0]
