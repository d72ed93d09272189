"""Timestamps, tiled SimHash and the filter audit against SQL and brute force."""

import random
import re
from collections import Counter
from datetime import UTC, datetime, timedelta
from itertools import permutations
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.llm import filter_audit, queries, simhash_tiles, timestamps

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_sweep_merge_timestamps", "op13_shapley_filter_audit"])
def test_same_as_sql(spark, name):
    from sqlcheck import against_sql

    mine, theirs = against_sql(spark, name)
    assert mine == theirs and mine


# timestamps


def _wall_to_utc(zone, wall):
    """(microseconds, skipped or repeated) by trying both offsets around a wall time."""
    tz = ZoneInfo(zone)
    found = set()
    for t in (wall - timedelta(days=1), wall + timedelta(days=1)):
        offset = t.replace(tzinfo=tz).utcoffset()
        found.add((offset, ((wall - offset).replace(tzinfo=UTC).astimezone(tz).replace(tzinfo=None) == wall)))
    right = [o for o, back in found if back]
    after = (wall + timedelta(days=1)).replace(tzinfo=tz).utcoffset()
    odd = len(found) == 2 and len(right) != 1
    offset = after if odd else right[0]
    return int((wall - offset).replace(tzinfo=UTC).timestamp()) * 1_000_000, odd


def test_wall_times_around_every_change(spark):
    rows, want = [], {}
    for zone in ("America/New_York", "Europe/Berlin", "Asia/Kolkata", "UTC", "Australia/Lord_Howe", "America/St_Johns", "Pacific/Apia"):
        for day in (datetime(2024, 3, 10), datetime(2024, 3, 31), datetime(2024, 11, 3), datetime(2024, 10, 27), datetime(2024, 4, 7), datetime(2024, 10, 6), datetime(2090, 6, 1), datetime(2000, 1, 1), datetime(2006, 4, 2)):
            for minutes in range(0, 300, 15):
                wall = day + timedelta(minutes=minutes)
                rows.append((len(rows), "s", zone, wall.strftime("%Y-%m-%d %H:%M:%S")))
                want[rows[-1][0]] = _wall_to_utc(zone, wall)
    got = timestamps.normalise(spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string")).collect()
    assert {r.stamp_id: (r.utc_us, r.ambiguous) for r in got} == want
    assert {r.rule for r in got} == {"plain"} and sum(x for _, x in want.values()) > 20


NOON = int(datetime(2024, 3, 5, 12, tzinfo=UTC).timestamp()) * 1_000_000
DAY = NOON - 12 * 3600 * 1_000_000
NOTATIONS = {
    "2024-03-05T12:00:00Z": NOON, "2024-03-05 12:00 Z": NOON, "20240305 12:00": NOON, "20240305": DAY, "05.03.2024 12:00:00": NOON, "05 Mar 2024 12:00 PM": NOON, "05 Mar 2024 12:00AM": DAY, "\t 05 Mar 2024 \x0b\x0c": DAY,
    "2024-03-05T14:00+0200": NOON, "2024-03-05T14:00 +02:00": NOON, "2024-03-05T02:00PM +0200": NOON, "2024-03-05T07:30-04:30": NOON, "1709640000": NOON, "1709640000000": NOON, " 1709640000123\r\n": NOON + 123_000,
    "2024-03-05 24:00": None, "2024-03-05 12:60": None, "2024-03-05 12:00:60": None, "2024-02-30": None, "2024-13-01": None, "1999-01-01": None, "2024-03-05 13:00 PM": None, "2024-03-05 00:00 AM": None, "2024-03-05T12:00+15:00": None,
    "2024-03-05T12:00+02:60": None, "2024-03-05t12:00": None, "05 mar 2024": None, "05 Mar  2024": None, "2024-3-5": None, "12345678901": None, "170964000": None, "2024-03-05\n12:00": None, "2024-03-05  12:00": None, " 2024-03-05": None,
    "2024-03-05Z": None, "": None, " ": None, "٢٠٢٤-٠٣-٠٥": None, "٠٧٠٩٦٤٠٠٠٠": None, "x" * 200_000: None, " " * 100_000 + "x" + " " * 100_000: None, None: None, "2024-03-05 12": None, "05/03/2024,12:00": None,
}


def test_notations(spark):
    rows = [(i, "s", "UTC", raw) for i, raw in enumerate(NOTATIONS)]
    got = {r.stamp_id: r for r in timestamps.normalise(spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string")).collect()}
    for (i, _, _, raw), want in zip(rows, NOTATIONS.values(), strict=True):
        assert got[i].utc_us == want, raw
        number = raw is not None and re.fullmatch(r"\s*\d{10}(\d{3})?\s*", raw, re.ASCII)
        assert got[i].rule == ("bad" if want is None else "epoch" if number else "plain"), raw
        assert not got[i].ambiguous


def test_votes_ties_nulls_and_clashes(spark, nothing):
    raws = [("a", "UTC", "13/01/2024"), ("a", "UTC", "14/01/2024"), ("a", "UTC", "01/14/2024"), ("a", "UTC", "02/03/2024"), ("a", "UTC", "02/03/2024"), ("b", "UTC", "01/20/2024 10:00"), ("b", "UTC", "02/03/2024"), ("b", "UTC", "03/03/2024"), ("c", "UTC", "02/03/2024")]
    # ties, a vote of a bad stamp, an unknown and a null zone, a null source, an offset that needs no zone
    raws += [("d", "UTC", "13/01/2024"), ("d", "UTC", "01/13/2024"), ("d", "UTC", "02/03/2024"), ("e", "UTC", "01/13/2024 25:00"), ("e", "UTC", "13/13/2024"), ("e", "UTC", "02/03/2024"), ("f", "Nowhere/Else", "01/13/2024"), ("f", None, "01/14/2024"), ("f", "UTC", "02/03/2024"), ("f", "../etc", "2024-01-01"), ("f", None, "2024-01-01T00:00Z"), (None, "UTC", "01/13/2024"), (None, "UTC", "02/03/2024"), ("f", "America", "2024-01-01")]
    df = spark.createDataFrame([(i, *r, {"k": i}, f"c{i}") for i, r in enumerate(raws)], "stamp_id long, source string, zone string, raw string, offset map<string,int>, rule string")
    out = timestamps.normalise(df)
    assert out.columns == ["stamp_id", "source", "zone", "raw", "offset", "utc_us", "rule", "ambiguous"]
    rows = sorted(out.collect(), key=lambda r: r.stamp_id)
    assert [r.offset for r in rows] == [{"k": i} for i in range(len(raws))]
    day = lambda us: None if us is None else datetime.fromtimestamp(us / 1e6, UTC).strftime("%m-%d")
    third, second = ("03-02", True), ("02-03", True)
    assert [(day(r.utc_us), r.ambiguous) for r in rows] == [("01-13", False), ("01-14", False), ("01-14", False), third, third, ("01-20", False), second, ("03-03", False), third, ("01-13", False), ("01-13", False), third, (None, False), (None, False), third, (None, False), (None, False), third, (None, False), ("01-01", False), ("01-13", False), second, (None, False)]
    assert [r.rule for r in rows if r.ambiguous] == ["votes", "votes", "votes", "default", "default", "default", "default", "votes"]
    assert timestamps.normalise(df.limit(0)).count() == 0
    assert timestamps.normalise(df, over=3.0).where("rule = 'votes'").count() == 2


def test_sweep_over_many_ranges(spark):
    """A hot key whose marks lie ranges apart, and rows that tie with each other and with marks."""
    rng = random.Random(1)
    marks = [("hot", t, t) for t in (0, 500_000, 500_001, 900_000)] + [(f"k{i}", 0, -i) for i in range(5)]
    rows = [("hot", rng.choice([0, 499_999, 500_000, 500_001, rng.randrange(10**6)]), i) for i in range(6000)] + [(f"k{i % 5}", rng.randrange(10), i) for i in range(100)]
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        out = timestamps.sweep(spark.createDataFrame(rows, "key string, at long, own long"), spark.createDataFrame(marks, "key string, at long, mark long"), ["key", "at"], ["mark"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    last = lambda key, at: max((t, m) for k, t, m in marks if k == key and t <= at)[1]
    assert Counter((r.key, r.at, r.own, r.mark) for r in out) == Counter((*r, last(*r[:2])) for r in rows)


# SimHash by tiles


def _print(text):
    from xxhash import xxh64_intdigest

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _least(prints, radius=2):
    """The smallest index of each one's component, by all pairs."""
    label, a = list(range(len(prints))), np.array(prints, np.uint64)
    changed = True
    while changed:
        changed = False
        for i in range(len(a)):
            near = np.flatnonzero(np.bitwise_count(a[i] ^ a) <= radius)
            low = min(label[j] for j in near)
            for j in near:
                changed, label[j] = changed or label[j] != low, low
    return label


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "É", "x y", " ", "\n", "\x1c", "the", "\t\t", "𝒳"]), max_size=40))
def test_fingerprint(parts):
    text = " ".join(parts)
    assert simhash_tiles.fingerprint(text) == _print(text)


def test_long_fingerprint(monkeypatch):
    text = " ".join(f"w{i * i % 7919}" for i in range(20_000))
    whole = simhash_tiles.fingerprint(text)
    monkeypatch.setattr(simhash_tiles, "HASHES", 999)
    assert simhash_tiles.fingerprint(text) == whole


def _crowds(seed):
    """Fingerprints of crowds around centres, chains, the extremes, and strangers."""
    rng = random.Random(seed)
    found = {0, 3, (1 << 64) - 1, (1 << 64) - 7}
    for centre in (rng.getrandbits(64), 0):
        for _ in range(60):
            p = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 6])):
                p ^= 1 << b
            found.add(p)
    p = rng.getrandbits(64)
    for _ in range(30):
        p ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        found.add(p)
    return sorted(found | {rng.getrandbits(64) for _ in range(60)})


@pytest.mark.parametrize("parts,tile,visitors", [(4, 4096, 32768), (4, 5, 7), (8, 3, 50), (16, 4096, 32768)])
def test_links_of_all_pairs(spark, parts, tile, visitors):
    prints = _crowds(parts * tile)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    found = simhash_tiles.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, parts, tile, visitors).collect()
    place = {p: i for i, p in enumerate(signed)}
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in found:
        x, y = root(place[a]), root(place[b])
        label[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(label))] == _least(prints)


def test_compared_in_bounded_cells(monkeypatch):
    prints = np.array(_crowds(3), np.uint64)
    whole = simhash_tiles.compared(prints[:100], prints[100:], True, 2)
    monkeypatch.setattr(simhash_tiles, "CELLS", 300)
    cut = simhash_tiles.compared(prints[:100], prints[100:], True, 2)
    assert [x.tolist() for x in whole] == [x.tolist() for x in cut] and len(whole[0]) < len(prints)


def test_neighbours_hold_all_within_the_radius():
    for parts in (4, 8, 16):
        moves = simhash_tiles.steps(parts, 2)
        both = {tuple(m) for m in moves} | {tuple(-m) for m in moves}
        assert len(both) == 2 * len(moves) - 1
        prints = np.array(_crowds(7), np.uint64)
        counts = simhash_tiles.tile_counts(prints, parts)
        near = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None]) <= 2)
        assert all(tuple(counts[i] - counts[j]) in both for i, j in near)


def test_near_duplicates(spark, odd, nothing, documents):
    for df in (odd, documents):
        rows = df.collect()
        got = simhash_tiles.near_duplicates(df).collect()
        assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r.doc_id, f"{_print(r.text):016x}") for r in rows)
        ordered = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
        label = _least([_print(r.text) for r in ordered])
        assert Counter((r.doc_id, r.component_id) for r in got) == Counter((r.doc_id, ordered[i].doc_id) for r, i in zip(ordered, label, strict=True))
    assert simhash_tiles.near_duplicates(nothing).count() == 0


def test_near_copies_are_linked(spark):
    """Texts that differ in a few of 900 words reach each other, the smallest id in a hot crowd of copies."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    texts = []
    for i in range(300):
        own = list(words)
        if i % 3:
            own[rng.randrange(900)] = f"changed{i}"
        texts.append((1000 - i, " ".join(own)))
    texts += [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(50))) for i in range(40)]
    got = {r.doc_id: r for r in simhash_tiles.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    ordered = sorted(texts)
    label = _least([int(got[i].fingerprint, 16) for i, _ in ordered])
    assert all(got[i].component_id == ordered[k][0] for (i, _), k in zip(ordered, label, strict=True))
    assert len({r.fingerprint for r in got.values()}) > 60 and sum(r.component_id > 700 for r in got.values()) > 200


# filters


def _fails(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) << 2 | bool(re.search("[#$%&*|]", text)) << 3


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "É", "x", " ", "\n", "#", "the", "ABC", " ", "a b c d e f g h i j k l m n o p q r s t u v w x y z"]), max_size=20), st.integers(1, 4))
def test_own_mask(parts, times):
    text = "".join(parts * times)
    assert filter_audit.own_mask(text) == _fails(text)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.tuples(st.integers(0, 9), st.integers(0, 4), st.integers(0, 4)), max_size=32))
def test_interactions_of_all_walks(counts):
    got, shares = {}, Counter()
    for row in filter_audit.interactions(counts):
        got[row[:2]] = row[2:]
    total = lambda j, keep: sum(c[j] for m, c in counts.items() if keep(m))
    want = {}
    for order in permutations(range(5)):
        before = 0
        for step, i in enumerate(order, 1):
            here = lambda m: m >> i & 1 and not m & before  # noqa: E731, B023
            removed = total(0, here)
            shares[i] += removed
            want["".join("ABCDE"[j] for j in order), step] = (total(0, lambda m: not m & (before | 1 << i)), removed, total(0, lambda m: m >> i & 1 and m & before), total(0, lambda m: m == 1 << i), total(1, here), total(2, here))  # noqa: B023
            before |= 1 << i
    assert {k: v[:6] for k, v in got.items()} == want
    assert all(v[6] == shares["ABCDE".index(k[0][k[1] - 1])] for k, v in got.items()) and len(got) == 600


def test_audit_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    long = " ".join(f"w{i % 5000}" for i in range(20_000))
    more = spark.createDataFrame([(50, long, "en", None, 1, None), (51, long, "en", "", 1, None), (None, long, "en", "a", 1, None)], odd.schema)
    df = odd.unionByName(more).selectExpr("*", "'x' AS part", "1 AS mask", "2 AS digest", "3 AS first", "4 AS times", "5 AS quality")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.filter_audit(df, labels).collect()}
    rows = df.select("doc_id", "source", "text").collect()
    assert len(got) == 600 * len({r.source or "" for r in rows}) and {k[0] for k in got} == {"", "a", "b", "c"}
    marks = {1: (1, 0), 2: (1, 1), 4: (0, 1), 99: (1, 1)}
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    for part in ("", "a", "b", "c"):
        counts = {}
        for r in rows:
            if (r.source or "") == part:
                mask = _fails(r.text or "") | 16 * (r.doc_id is not None and r.doc_id > least[r.text or ""])
                counts[mask] = tuple(x + y for x, y in zip(counts.get(mask, (0, 0, 0)), (1, *marks.get(r.doc_id, (0, 0))), strict=True))
        for order, step, *numbers in filter_audit.interactions(counts):
            assert list(got[part, order, step])[3:] == numbers
    assert filter_audit.filter_audit(nothing, labels).count() == 0
    assert filter_audit.filter_audit(odd, labels.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_registered():
    for n in (11, 12, 13):
        assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1
