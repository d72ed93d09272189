"""Findings on larger tables: rounding as SQL has it, and tasks whose size doesn't grow with the table."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from sqlcheck import against_sql

from weirflow.operators import forest, grow, prefix, split, tree
from weirflow.plans import registry
from weirflow.sources import flows as S
from weirflow.storage import wide_plans


def _events(folder, rows):
    """An events table (id, time, value) in a folder of its own."""
    folder.mkdir()
    listed = ", ".join(f"({i}, TIMESTAMP '{ts}', {value}::DOUBLE)" for i, ts, value in rows)
    duckdb.sql(f"COPY (SELECT i::BIGINT AS event_id, ts, i::BIGINT AS user_id, 'click' AS event_type, v AS value, '{{}}' AS props FROM (VALUES {listed}) t(i, ts, v)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("last", ["23:59:30.75", "23:59:30.5", "23:59:31.5", "23:59:30.25"])
def test_age_of_minutes_rounds_as_sql(spark, tmp_path, last):
    sf = _events(tmp_path / "sf", [(1, "2024-01-01 22:58:00", 1), (2, "2024-01-01 23:10:00", 1), (3, f"2024-01-01 {last}", 1)])
    mine, theirs = against_sql(spark, "state_ttl", sf)
    assert mine == theirs and mine


@pytest.mark.parametrize("mean, text", [(53.40325, "53.4032"), (0.03125, "0.0312"), (1.00005, "1.0001"), (0.12345, "0.1235"), (2.0, "2.0000")])
def test_mean_in_the_log_rounds_as_sql(spark, mean, text):
    shot = spark.createDataFrame([(3, 1, mean, 2, 0)], "total_requests long, active long, avg_duration double, requests_per_minute long, errors long")
    assert f"Avg Response: {text}s" in shot.select(S.metrics_message(shot).alias("m")).first().m
    assert duckdb.sql(f"SELECT printf('%.4f', {mean}::DOUBLE)").fetchall()[0][0] == text


def test_monitor_of_a_tie(spark, tmp_path):
    sf = _events(tmp_path / "sf", [(1, "2024-01-01 22:58:00", 53.40325), (2, "2024-01-01 23:04:30", 53.40325), (3, "2024-01-01 23:10:00", 53.40325)])
    mine, theirs = against_sql(spark, "stream_monitor", sf)
    assert mine == theirs and len(mine) == 1


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(forest, "PART_BYTES", 100_000)
    parts, fit = [], forest.RandomForestClassifier.fit
    monkeypatch.setattr(forest.RandomForestClassifier, "fit", lambda self, df: parts.append([r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]) or fit(self, df))
    for n in (2_000, 8_000):  # all rows of a class are equal
        df = spark.range(n).select((F.col("id") % 2).alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"))
        model, classes = forest.fit_forest(df, ["x"], "y", n_estimators=2, max_depth=2)
        assert classes == ["a", "b"] and forest.score(model, df, ["x"], classes).where("label_predicted <> y").count() == 0
    assert [sum(p) for p in parts] == [2_000, 8_000] and len(parts[1]) > 3 * len(parts[0]) and max(parts[1]) < 2 * max(parts[0])


def test_split_in_bounded_chunks(spark, monkeypatch):
    rows = [("u" if i % 3 else "v", None if i % 50 == 0 else float(i * 37 % 211), float(i % 4), "abc"[i * i % 7 % 3], 0.5 + i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "node string, x double, z double, y string, w double")
    monkeypatch.setattr(prefix, "CHUNK_ROWS", 20)
    monkeypatch.setattr(split, "PART_VALUES", 100)
    held, placed = [], prefix._placed
    monkeypatch.setattr(prefix, "_placed", lambda chunks, *a: held.append([r[1] for r in chunks.groupBy(F.spark_partition_id()).count().collect()]) or placed(chunks, *a))
    for fits in (lambda *a: True, lambda *a: False):  # the chunks' beginnings broadcast, or joined by a merge
        monkeypatch.setattr(prefix, "fits", fits)
        rated = split.split_candidates(df, "node", ["x", "z"], "y", ["a", "b", "c"], "w")
        best = {r.node: r for r in split.best_split(rated, "node", 5).collect()}
        found = {(r.node, r.feature, r.threshold): r for r in rated.collect()}
        wanted = {}
        for node in "uv":
            for f, at in (("x", 1), ("z", 2)):
                own = [r for r in rows if r[0] == node and r[at] is not None]
                values = sorted({r[at] for r in own})
                for low, high in zip(values, values[1:], strict=False):
                    sums = [[sum(r[4] for r in own if (r[at] <= low) == side and r[3] == c) for c in "abc"] for side in (True, False)]
                    wanted[node, f, (low + high) / 2] = (sums, sum(r[at] <= low for r in own), sum(r[at] > low for r in own))
        assert found.keys() == wanted.keys()
        for k, (sums, cl, cr) in wanted.items():
            r = found[k]
            assert (r.cl, r.cr) == (cl, cr) and r.left_weights == pytest.approx(sums[0]) and r.right_weights == pytest.approx(sums[1])
        for node in "uv":
            most = max(r.proxy for k, r in found.items() if k[0] == node and min(r.cl, r.cr) >= 5)
            assert best[node].proxy == most
    assert all(len(sizes) > 10 and max(sizes) <= 3 * prefix.CHUNK_ROWS for sizes in held)


def test_flow_files_are_more_not_larger(spark, monkeypatch):
    monkeypatch.setattr(registry, "FILE_ROWS", 300)
    landing, files = registry._flow_files(spark, "/root/testdata/sf0.001")
    sizes = [r[0] for r in spark.read.text(f"{landing}/*").groupBy(F.input_file_name()).count().select("count").collect()]
    assert files == 4 and len(sizes) == 24 and max(sizes) < 2 * 300
    mine, theirs = against_sql(spark, "stream_flow_files")
    assert mine == theirs


def test_types_of_later_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "HEAD_ROWS", 2)
    rows = [("1", "1", "1", "a", "1.5", None, None), ("2", "2", "2", "b", "2", None, None), ("3", "x", "inf", "1", "3", "7", None), (" -4 ", "4", "4", "2", "y", None, "NaN")]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(7))).coalesce(1)
    looked, agg = [], type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: looked.append(" ".join(map(str, a))) or agg(self, *a))
    assert [f.dataType.simpleString() for f in S.flow_types(df)] == ["bigint", "string", "double", "string", "string", "bigint", "double"]
    assert len(looked) == 2 and "c3" not in looked[1]  # text by the first rows: not looked at again


def test_tally_without_a_class():
    one = np.zeros(3, int)
    *_, sums = split.tallied(one, one, np.array([1.0, 1.0, 2.0]), one, np.full(3, 0.5), 2)
    assert [s.dtype for s in sums] == [float, float] and [s.tolist() for s in sums] == [[1.0, 0.5], [0.0, 0.0]]


@pytest.mark.parametrize("params", [
    {"max_depth": 3}, {"max_depth": 3, "min_samples_leaf": 150, "weight": "w"}, {"max_depth": 3, "min_weight_fraction_leaf": 0.2, "weight": "w"}, {"max_depth": 4, "max_features": 1, "random_state": 3},
])
def test_ranges_find_the_same_splits(spark, monkeypatch, params):
    rng = np.random.default_rng(5)
    n = 4_000
    x = [rng.random(n) * 100, rng.integers(0, 8, n).astype(float), np.round(rng.normal(0, 1, n), 1), np.ones(n), np.where(rng.random(n) < 0.3, -np.inf, rng.exponential(2, n))]
    y = np.where(rng.random(n) < 0.3, rng.integers(0, 3, n), (x[0] > 37.5).astype(int) + (x[4] > 1.5))
    rows = [(*map(float, r), "abc"[c], float(w)) for *r, c, w in zip(*x, y, rng.integers(0, 4, n) / 2, strict=True)]
    df = spark.createDataFrame(rows, "f0 double, f1 double, f2 double, f3 double, f4 double, y string, w double").coalesce(3)
    weight = params.pop("weight", None) if (params := dict(params)) else None
    fit = lambda: [tuple(r) for r in tree.Tree(**params).fit(df, [f"f{i}" for i in range(5)], "y", weight).collect()]
    one_by_one = fit()
    counted, summed = [], grow.summed
    monkeypatch.setattr(grow, "summed", lambda tallies, classes, most: counted.append(most) or summed(tallies, classes, most))
    for name, value in (("RANGES", 128), ("LEAST_RANGES", 4), ("RANGE_ROWS", 2)):
        monkeypatch.setattr(grow, name, value)
    levels = []
    by_ranges = grow._by_ranges
    monkeypatch.setattr(grow, "_by_ranges", lambda *a: levels.append(1) or by_ranges(*a))
    assert fit() == one_by_one and len(one_by_one) > 5
    assert levels and counted[0] < n  # of all features' values, few are counted one by one at the root


def test_scoring_without_a_list_for_each_row(spark):
    nodes = spark.createDataFrame([(0, 0, 1, 2, 0, 1.5, [0.5, 0.5]), (0, 1, -1, -1, -2, -2.0, [1.0, 0.0]), (0, 2, -1, -1, -2, -2.0, [0.25, 0.75])], "tree_id int, node_id int, left int, right int, feature int, threshold double, value array<double>")
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "x double")
    found = [(r.p0, r.p1, r.label_predicted) for r in forest.score_nodes(df, nodes, ["x"], ["a", "b"]).collect()]
    assert found == [(1.0, 0.0, "a"), (0.25, 0.75, "b"), (0.25, 0.75, "b")]


def test_wide_plans_run_as_compiled_code(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), wide_plans(spark):
        assert int(spark.conf.get(name)) <= 8000  # the JVM interprets larger methods
        raise KeyError
    assert spark.conf.get(name) == before
