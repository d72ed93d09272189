"""Flow files, programs, forests, trees and streams: against brute force, round trips and small examples."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow import programs
from weirflow.functions import features as X
from weirflow.operators import analyze, clean, compiled, evaluate, forest, grow, metrics, prefix, split, tree
from weirflow.plans import registry
from weirflow.sources import flows as S
from weirflow.streaming import detect

SF = "/root/testdata/sf0.001"


def _csv(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    return f"file://{folder}/{name}"


def _flow_lines(spark, skip=0, rows=400):
    table = registry.flow_table(spark, SF).toPandas()[skip : skip + rows]
    return [",".join(table.columns), *[",".join(map(str, r)) for r in table.itertuples(index=False)]]


def test_flow_csv(spark, tmp_path):
    path = _csv(tmp_path / "in", "a.csv", ["Flow Bytes/s,Src IP,n,odd", "inf,10.0.0.1,1,x", "-Infinity,,2,3", "NaN,nan,3,", "1.5,b, 4 ,4"])
    df = S.read_flows(spark, path)
    assert [t for _, t in df.dtypes] == ["double", "string", "bigint", "string"]
    rows = df.collect()
    assert rows[0][0] == math.inf and rows[1][0] == -math.inf and rows[2][0] is None and rows[2][1] is None and rows[3][2] == 4
    cleaned = clean.infinite_to_null(df)
    assert [r[0] for r in cleaned.collect()] == [None, None, None, 1.5] and clean.drop_any_null(cleaned).count() == 1
    with pytest.raises(KeyError):
        clean.drop_columns(df, ["absent"])
    given = S.read_flows(spark, path, S.T.StructType([S.T.StructField("odd", S.T.LongType())]))
    assert [r[0] for r in given.collect()] == [None, 3, None, 4]


def test_removed_names_are_twelve():
    assert len(clean.REMOVE) == 12 and {"Fwd Segment Size Avg", "Bwd Segment Size Avg", "Fwd IAT Total", "Bwd PSH Flags", "Fwd URG Flags"} <= set(clean.REMOVE)


def test_repeats_are_whole_rows_before_identifiers_go(spark):
    cols = ["Flow ID", "x", "Label"]
    df = spark.createDataFrame([("a", 1.0, "BENIGN"), ("a", 1.0, "BENIGN"), ("b", 1.0, "BENIGN"), ("c", 1.0, "other"), ("d", None, "BENIGN")], cols)
    assert clean.clean_flows(df, remove=["Flow ID"]).collect() == [(1.0, "BENIGN")] * 2
    assert clean.clean_flows(df, label=None, remove=["Flow ID"]).count() == 3


def test_engineer_skips_missing_flags(spark):
    cols = "`SYN Flag Count` int, `FIN Flag Count` int, `RST Flag Count` int, `ACK Flag Count` string, `Fwd IAT Mean` double, `Bwd IAT Mean` double"
    df = spark.createDataFrame([(None, 2, 3, "1", 3.0, 0.0), (0, 0, 0, "bad", 1.0, 2.0)], cols)
    a, b = X.engineer(df).collect()
    assert (a.Total_Flags, a.Flag_Diversity, a.Control_Flag_Ratio, a.IAT_ratio) == (6.0, 3, 5 / 6, 30.0)
    assert (b.Total_Flags, b.Flag_Diversity, b.Control_Flag_Ratio, b["ACK Flag Count"], b.IAT_ratio) == (0.0, 0, 0.0, 0.0, 0.5)
    assert "Packet_Size_CV" not in X.engineer(df).columns


def test_correlations_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    x[:, 1], x[:, 2], x[:, 3] = x[:, 0] * 2 + 1e-3 * x[:, 1], -x[:, 0], 7.0
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"c {i}" for i in range(5)])
    got = {(r.feature_a, r.feature_b): r.r for r in analyze.correlations(df, df.columns).collect()}
    for i in range(5):
        for j in range(i):
            r = got[f"c {i}", f"c {j}"]
            assert r is None if 3 in (i, j) else r == pytest.approx(np.corrcoef(x[:, i], x[:, j])[0, 1])
    assert analyze.kept_features(df, df.columns) == ["c 0", "c 2", "c 4"]
    assert analyze.correlations(df.limit(0), ["c 0", "c 1"]).collect() == [("c 1", "c 0", None)]


def test_pairs_with_missing_values_against_pandas(spark):
    """Each pair over its own complete rows, in few and many partitions; large means, infinities, constants and empty columns."""
    import pandas as pd

    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 7))
    x[:, 1] = 1e9 + x[:, 0] + 0.1 * x[:, 1]
    x[:, 2], x[:, 4], x[:, 5] = 0.1, np.nan, -x[:, 0] ** 3
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:490, 6] = np.nan
    table = pd.DataFrame(x, columns=[f"c {i}" for i in range(7)])
    df = spark.createDataFrame([tuple(None if v != v and i % 2 else float(v) for i, v in enumerate(r)) for r in x], ", ".join(f"`c {i}` double" for i in range(7)))
    want = table.corr(min_periods=2)
    for parts in (1, 9):
        got = {(r.feature_a, r.feature_b): r.r for r in analyze.correlations(df.repartition(parts), df.columns).collect()}
        assert len(got) == 21
        for (a, b), r in got.items():
            w = want.loc[a, b]
            assert r is None if 2 in (int(a[2:]), int(b[2:])) or w != w else r == pytest.approx(w, abs=1e-7), (a, b)
        flat, _ = analyze.analyse(df.repartition(parts), df.columns)
        assert flat == ["c 2"]
        spread = {r.feature: r.variance for r in analyze.variances(analyze.moments(df.repartition(parts), df.columns), df.columns).collect()}
        assert all(spread[c] == pytest.approx(table[c].var(), rel=1e-6) for c in ("c 0", "c 1", "c 3", "c 5", "c 6")) and "c 4" not in spread
    odd = spark.createDataFrame([(1.0, 2.0), (float("inf"), 3.0)], "a double, b double")
    assert analyze.correlations(odd, ["a", "b"]).first().r is None


def test_ranks_and_rolling_means(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["a", None]), i, rng.choice([None, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(5)
    ranked = {(r.k, r.t): r._rank for r in prefix.ranked(df, ["k"], ["t"]).collect()}
    for n in (1, 7, 50, 4000):
        got = {(r.k, r.t): r.rolling_avg for r in metrics.rolling_average(df, ["k"], "v", ["t"], n).collect()}
        for key in ("hot", "a", None):
            own = [r for r in rows if r[0] == key]
            for i, (_, t, _) in enumerate(own):
                vs = [v for *_, v in own[max(0, i - n + 1) : i + 1] if v is not None]
                assert ranked[key, t] == i + 1
                assert got[key, t] == (pytest.approx(sum(vs) / len(vs)) if vs else None)


def test_special_values_leave_the_rolling_mean(spark):
    rng = random.Random(2)
    kinds = [math.nan, math.inf, -math.inf, 1e17, -1e17, 1e300, 1e-13, None, 0.5, 1.0, 2.0, 3.0]
    values = [rng.choice(kinds) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "t int, v double").withColumn("k", F.lit("x")).repartition(3)
    for n in (1, 2, 3, 10):
        for r in metrics.rolling_average(df, ["k"], "v", ["t"], n).collect():
            vs = [v for v in values[max(0, r.t - n + 1) : r.t + 1] if v is not None]
            want = math.fsum(vs) / len(vs) if vs and all(map(math.isfinite, vs)) else sum(vs) / len(vs) if vs else None
            near = 1e-15 * sum(map(abs, vs))  # of a plain sum of so few values
            assert r.rolling_avg == want or (want is not None and (math.isnan(want) and math.isnan(r.rolling_avg) or abs(r.rolling_avg - want) <= near)), (n, vs)


@pytest.mark.parametrize("key", [["k"], []])
def test_floored_gauge_over_tasks(spark, key):
    """One key with all rows in many ranges, small ones and a null key; null changes do nothing."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 20 + ["a", None]), i, rng.choice([1, 1, -1, -1, -1, None])) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t int, c int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {r.t: (r.gauge, r.active) for r in metrics.running_gauge(df, key, F.col("c"), ["t"]).collect()}
        tasks = prefix.chunked(df, key, ["t"]).where("k = 'hot'").select(prefix.CHUNK).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert tasks > 2
    state = {}
    for k, t, c in rows:
        at = k if key else ""
        gauge, active = state.get(at, (0, 0))
        state[at] = (gauge + (c or 0), max(0, active + (c or 0)))
        assert got[t] == state[at]
    assert metrics.running_gauge(df.limit(0), key, F.col("c"), ["t"]).count() == 0


def test_confusion_has_all_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b"), ("c", "a"), ("c", None)], "y string, p string")
    rows = {r.y: (r.pred_a, r.pred_b, r.pred_c) for r in evaluate.confusion(df, "y", "p", ["a", "b", "c"]).collect()}
    assert {k: v for k, v in rows.items() if k is not None} == {"a": (1, 2, 0), "b": (0, 0, 0), "c": (1, 0, 0)}


def _brute_tree(x, y, w, classes, p, subset=None):
    """Nodes in pre-order by plain loops: (left, right, feature, threshold, impurity, rows, weight, shares)."""
    x, total, out = x.astype(np.float32).astype(float), w.sum(), []
    weights = lambda i: np.array([w[i][y[i] == c].sum() for c in classes])
    impurity = lambda c: 1 - (c**2).sum() / c.sum() ** 2
    least = p.min_weight_fraction_leaf * total

    def grow(i, depth):
        at, c = len(out), weights(i)
        out.append(None)
        best = None
        leaf = (p.max_depth is not None and depth >= p.max_depth) or len(i) < max(p.min_samples_split, 2 * p.min_samples_leaf) or c.sum() < 2 * least or impurity(c) <= tree.EPSILON
        for f in range(0 if leaf else x.shape[1]):
            values = np.unique(x[i, f])
            for a, b in zip(values, values[1:], strict=False):
                if b - a <= split.GAP:
                    continue
                left, right = i[x[i, f] <= a], i[x[i, f] > a]
                cl, cr = weights(left), weights(right)
                if min(len(left), len(right)) < p.min_samples_leaf or min(cl.sum(), cr.sum()) < least:
                    continue
                proxy = (cl**2).sum() / cl.sum() + (cr**2).sum() / cr.sum()
                if best is None or proxy > best[0]:
                    best = (proxy, f, a / 2 + b / 2, left, right, c.sum() / total * (impurity(c) - cr.sum() / c.sum() * impurity(cr) - cl.sum() / c.sum() * impurity(cl)))
        if best is None or best[5] + tree.EPSILON < p.min_impurity_decrease:
            out[at] = (-1, -1, -2, -2.0, impurity(c), len(i), c.sum(), (c / c.sum()).tolist())
            return
        left = len(out)
        grow(best[3], depth + 1)
        right = len(out)
        grow(best[4], depth + 1)
        out[at] = (left, right, best[1], best[2], impurity(c), len(i), c.sum(), (c / c.sum()).tolist())

    grow(np.flatnonzero(w != 0), 0)
    return out


@pytest.mark.parametrize("params", [{"max_depth": 3}, {"min_samples_leaf": 6, "min_weight_fraction_leaf": 0.1}, {"min_samples_split": 15, "min_impurity_decrease": 0.01}])
def test_tree_against_brute_force(spark, params):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 3)), 1)
    x[:, 2] = 1.0
    y = np.where(x[:, 0] + rng.normal(size=60) * 0.5 > 0, "b", np.where(x[:, 1] > 0.5, "c", "a"))
    w = rng.integers(0, 4, 60).astype(float)
    df = spark.createDataFrame([(*map(float, a), str(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], "f1 double, f2 double, f3 double, y string, w double")
    t = tree.Tree(**params)
    got = [tuple(r)[2:10] for r in t.fit(df, ["f1", "f2", "f3"], "y", "w").orderBy("node_id").collect()]
    expected = _brute_tree(x, y, w, t.classes, t)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[3:7] == pytest.approx(e[3:7]) and list(g[7]) == pytest.approx(e[7])


def test_hand_computed_tree(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "b"), (4.0, "b")], "x double, y string")
    nodes = tree.Tree().fit(df, ["x"], "y")
    root = nodes.where("node_id = 0").first()
    assert (root.threshold, root.impurity, root.feature_name, nodes.count()) == (2.5, 0.5, "x", 3)
    assert forest.named_importance(forest.forest_importance(nodes), ["x"]).collect() == [("x", 1.0)]
    assert tree.Tree().fit(df.limit(0), ["x"], "y").count() == 0
    close = spark.createDataFrame([(1.0, "a"), (1.0 + 1e-9, "b")], "x double, y string")
    assert split.split_candidates(close.selectExpr("0 AS node", "x", "y"), "node", ["x"], "y", ["a", "b"]).count() == 0


def _drawn_tree(x, y, w, classes, p, seed, subset):
    """A tree by plain loops whose nodes try features in their random order until `subset` are tried, known constants too, and one isn't constant."""
    nodes = []
    impurity = lambda c: 1 - (c**2).sum() / c.sum() ** 2
    weights = lambda i: np.array([w[i][y[i] == c].sum() for c in range(classes)])
    nodes.append([np.flatnonzero(w > 0), frozenset(), None])
    level, depth = [0], 0
    while level and depth < p.max_depth:
        following = []
        for at in level:
            i, known, _ = nodes[at]
            c = weights(i)
            if len(i) < 2 or impurity(c) <= grow.EPSILON:
                continue
            tried, found, best = 0, set(known), None
            for f in grow.draw(seed, at, x.shape[1]):
                if tried >= subset and any(g not in found for g in visited):
                    break
                if tried == 0:
                    visited = []
                tried += 1
                visited.append(f)
                values = np.unique(x[i, f])
                if values[-1] - values[0] <= split.GAP:
                    found.add(f)
                    continue
                for lo, hi in zip(values, values[1:], strict=False):
                    l, r = i[x[i, f] <= lo], i[x[i, f] > lo]
                    cl, cr = weights(l), weights(r)
                    key = ((cl**2).sum() / cl.sum() + (cr**2).sum() / cr.sum(), -f, -lo)
                    if best is None or key > best[0]:
                        best = (key, f, lo / 2 + hi / 2, l, r)
            if best:
                nodes[at][2] = (best[1], best[2], len(nodes), len(nodes) + 1)
                following += [len(nodes), len(nodes) + 1]
                nodes += [[best[3], frozenset(found), None], [best[4], frozenset(found), None]]
        level, depth = following, depth + 1
    return [(len(i), s) for i, _, s in nodes]


@pytest.mark.parametrize("subset", [1, 2])
def test_features_are_drawn_with_constants(spark, subset):
    """Columns that are constant from the start, or become so: drawn ones count as tried, the next that isn't constant is added."""
    rng = np.random.default_rng(8)
    x = np.stack([np.full(70, 3.0), rng.integers(0, 2, 70), np.round(rng.normal(size=70), 1), np.full(70, -1.0), rng.integers(0, 3, 70)], axis=1)
    x[:, 3] = np.where(x[:, 1] > 0, rng.integers(0, 4, 70), 7.0)
    y = rng.integers(0, 2, 70)
    y[x[:, 2] > 0.7] = 1
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(*map(float, a), "ab"[b]) for a, b in zip(x, y, strict=True)], "f0 double, f1 double, f2 double, f3 double, f4 double, y string")
    rows = tree.checked_rows(df, [f"f{i}" for i in range(5)], "y", None).select("x", F.when(F.col("_label") == "a", 0).otherwise(1).alias("y"), "w", F.array(F.lit(0), F.lit(1)).alias("trees"), F.array(F.lit(1), F.lit(1)).alias("times"))
    p = tree.Tree(max_depth=5, max_features=subset, random_state=11)
    both = grow.grow(rows.cache(), 5, 2, p.rules(5, trees=2))
    for t, nodes in enumerate(both):
        got = [(n.rows, None if n.left < 0 else (n.feature, n.threshold, n.left, n.right)) for n in nodes]
        assert got == _drawn_tree(x, y, np.ones(70), 2, p, 11 + t, subset)
    assert both[0][0].feature != 0 and any(n.feature == 3 for t in both for n in t)


def test_all_trees_at_once_are_the_trees_one_by_one(spark):
    """A forest over real samples equals each tree grown alone on its own sample's weights."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(60, 3)), 1)
    df = spark.createDataFrame([(i, *map(float, a), "pqr"[int(a[0] + a[1] > 0) + int(a[2] > 0)]) for i, a in enumerate(x)], "id int, a double, b double, c double, y string")
    p = forest.ForestParams(n_estimators=4, max_depth=4, max_features=None, max_samples=0.8)
    nodes, classes, accuracy = forest.fit_exact_forest(df, ["a", "b", "c"], "y", p, ["id"])
    assert accuracy is None
    for t in range(4):
        slots = spark.range(forest.samples_drawn(60, 0.8)).selectExpr("id AS slot", f"{t} AS tree")
        draws = forest.drawn_rows(slots, "tree", "slot", 60, p.random_state, "id").groupBy("id").agg(F.count(F.lit(1)).alias("times"))
        own = tree.Tree(max_depth=4)
        alone = own.fit(df.join(draws, "id"), ["a", "b", "c"], "y", "times").orderBy("node_id").collect()
        assert own.classes == classes
        assert [tuple(r)[1:] for r in alone] == [tuple(r)[1:] for r in nodes.where(f"tree_id = {t}").orderBy("node_id").collect()]


def test_compiled_forests_of_any_depth(spark, monkeypatch):
    """Array descent equals plain descent: missing values go right, a chain deeper than MLlib's trees, groups of trees."""
    rng = random.Random(10)
    chain = [(0, i, i + 1 if i < 80 else -1, i + 81 if i < 80 else -1, i % 2 if i < 80 else -2, float(80 - i), 0.0, 1, 1.0, [i / 80, 1 - i / 80], 0.0) for i in range(81)]
    chain += [(0, i, -1, -1, -2, -2.0, 0.0, 1, 1.0, [1.0, 0.0], 0.0) for i in range(81, 161)]
    stump = [(3, 0, 1, 2, 1, 0.5, 0.0, 1, 1.0, [0.5, 0.5], 0.0), (3, 1, -1, -1, -2, -2.0, 0.0, 1, 1.0, [0.25, 0.75], 0.0), (3, 2, -1, -1, -2, -2.0, 0.0, 1, 1.0, [0.75, 0.25], 0.0)]
    nodes = spark.createDataFrame([*stump, *rng.sample(chain, len(chain))], S.NODE_SCHEMA)
    rows = [(f"r{i}", rng.choice([None, float("nan"), rng.uniform(-5, 90)]), rng.uniform(-5, 90)) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, a double, b double")
    table = {(n[0], n[1]): n for n in [*stump, *chain]}

    def leaf(t, a, b):
        at = table[t, 0]
        while at[2] >= 0:
            v = (a, b)[at[4]]
            at = table[t, at[2] if v is not None and np.float32(v) <= at[5] else at[3]]
        return at

    want = {(r[0], t): leaf(t, *r[1:])[1] for r in rows for t in (0, 3)}
    for most in (compiled.BROADCAST_NODES, 161):
        monkeypatch.setattr(forest, "compiled", lambda n, most=most: compiled.compiled(n, most))
        assert {(r.id, r.tree_id): r.node_id for r in forest.descend(df, nodes, "id", ["a", "b"]).collect()} == want
        scored = forest.score_nodes(df, nodes, ["a", "b"], ["x", "y"])
        assert scored.columns == ["id", "a", "b", "p0", "p1", "label_predicted"]
        for r in scored.collect():
            p0 = (leaf(0, r.a, r.b)[9][0] + leaf(3, r.a, r.b)[9][0]) / 2
            assert r.p0 == pytest.approx(p0) and r.label_predicted == ("x" if r.p0 >= r.p1 else "y")
    plan = forest.score_nodes(df, nodes, ["a", "b"], ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    monkeypatch.setattr(forest, "compiled", lambda n: compiled.compiled(n, 100))
    with pytest.raises(ValueError, match="161 nodes"):
        forest.descend(df, nodes, "id", ["a", "b"])


def test_bad_input_raises(spark):
    df = spark.createDataFrame([(1.0, "a", "x", -1.0), (2.0, "b", "y", 1.0)], "f double, y string, t string, w double")
    for bad in (lambda: tree.Tree().fit(df, ["t"], "y"), lambda: tree.Tree().fit(df, ["f"], "none"), lambda: tree.Tree().fit(df, ["none"], "y"), lambda: tree.Tree().fit(df, [], "y")):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(Exception, match="below zero"):
        tree.Tree().fit(df, ["f"], "y", "w")


def test_a_model_that_grows_too_large_raises(spark, monkeypatch):
    monkeypatch.setattr(grow, "MODEL_NODES", 4)
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(8)], "f double, y string")
    with pytest.raises(ValueError, match="limit max_depth"):
        tree.Tree().fit(df, ["f"], "y")


def test_forest_rules():
    assert [forest.max_features(r, 10) for r in (None, "sqrt", "log2", 0.55, 0.01, 4)] == [10, 3, 3, 5, 1, 4]
    assert [forest.samples_drawn(10, m) for m in (None, 4, 0.55, 0.01)] == [10, 4, 6, 1]
    for bad in (lambda: forest.samples_drawn(10, 11), lambda: forest.max_features("x", 3), *[lambda p=p: forest.ForestParams(**p).checked(False) for p in ({"n_estimators": 0}, {"bootstrap": False, "max_samples": 2}, {"bootstrap": False, "oob_score": True}, {"max_depth": 31}, {"max_leaf_nodes": 3}, {"criterion": "x"})]):
        with pytest.raises(ValueError):
            bad()


def test_node_table_predicts_as_the_model(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").limit(500).withColumn("id", F.monotonically_increasing_id())
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    model, classes = forest.fit_forest(rows, names, "l_returnflag", n_estimators=4, max_depth=5, class_weight="balanced")
    said = {r.id: (r.label_predicted, list(r.probability)) for r in forest.score(model, rows, names, classes, proba=True).collect()}
    nodes = forest.node_table(spark, model)
    path = f"file://{tmp_path}/nodes"
    S.save_nodes(nodes, path)
    votes = forest.vote(forest.leaf_values(forest.descend(rows, S.load_nodes(spark, path), "id", names), nodes), "id", classes).collect()
    assert len(votes) == 500
    for r in votes:
        assert [r.p0, r.p1, r.p2] == pytest.approx(said[r.id][1])
        assert r.label_predicted == said[r.id][0] or sorted(said[r.id][1])[-1] == pytest.approx(sorted(said[r.id][1])[-2])
    with pytest.raises(ValueError):
        forest.descend(rows, nodes, "id", names, depth=1)
    with pytest.raises(ValueError):
        S.save_nodes(nodes.limit(0), path) or S.load_nodes(spark, path)


def test_exact_forest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    df = spark.createDataFrame([(i, float(a), float(b), "p" if a + b > 0 else "n") for i, (a, b) in enumerate(x)], "id int, a double, b double, y string")
    p = forest.ForestParams(n_estimators=3, max_depth=4, max_features=None, oob_score=True, class_weight={"p": 2.0})
    nodes, classes, accuracy = forest.fit_exact_forest(df, ["a", "b"], "y", p, ["id"])
    votes = forest.vote(forest.leaf_values(forest.descend(df, nodes, "id", ["a", "b"]), nodes), "id", classes).join(df, "id")
    assert votes.where("label_predicted = y").count() >= 72 and 0.6 <= accuracy <= 1.0
    assert nodes.where("node_id = 0").agg(F.sum("n_node_samples")).first()[0] < 3 * 80  # a sample leaves rows out


def test_label_counts_keep_unknown_labels(spark):
    df = spark.createDataFrame([("a",), ("x",), ("a",), (None,)], "label string")
    assert {(r.label, r.n) for r in evaluate.label_counts(df, "label", ["a", "b"]).collect()} == {("a", 2), ("b", 0), ("x", 1), (None, 1)}
    assert {(r.label, r.n) for r in evaluate.label_counts(df.limit(0), "label", ["a", "b"]).collect()} == {("a", 0), ("b", 0)}


def test_train_and_detect(spark, tmp_path):
    """The two programs from CSV files to counts: what training selects is what detection looks for."""
    train = S.read_flows(spark, _csv(tmp_path / "train", "train.csv", _flow_lines(spark, 0, 1500)))
    test = S.read_flows(spark, _csv(tmp_path / "test", "test.csv", _flow_lines(spark, 1500, 500)))
    run = programs.train(train, test, f"file://{tmp_path}/model", trees=4, depth=5)
    assert run.selected and set(run.selected) <= {r.feature_name for r in run.importances.collect()}
    assert "RST Flag Count" in run.low_variance and "Bwd Packet Length Mean" in run.dropped and not {*run.dropped, *run.low_variance} & set(run.selected)
    assert [r["column"] for r in run.missing.collect()] == ["Flow Bytes/s"]
    tested = clean.clean_flows(test).count()
    assert run.predictions.count() == tested and run.report.where("class = 'accuracy'").first().support == tested
    assert run.confusion.select(sum(F.col(c) for c in run.confusion.columns[1:]).alias("n")).agg(F.sum("n")).first()[0] == tested
    lines = _flow_lines(spark, 0, 60)
    landing = tmp_path / "landing"
    _csv(landing, "1.csv", lines[:41])
    _csv(landing, "2.csv", [lines[0], lines[1], lines[1], *lines[41:]])
    out = f"file://{tmp_path}/out"
    programs.detect_flows(spark, f"file://{landing}", train.schema, f"file://{tmp_path}/model", out, f"file://{tmp_path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(out).collect()
    per_batch = {b: sum(r.n for r in rows if r.batch_id == b) for b in {r.batch_id for r in rows}}
    finite = lambda ls: len({x for x in ls if "inf" not in x})
    assert sorted(per_batch.values()) == sorted([finite(lines[1:41]), finite([lines[1], *lines[41:]])])
    assert all({r.label for r in rows if r.batch_id == b} >= set(clean.LABELS) for b in per_batch)
    detect.clear(spark, out)
    assert not (tmp_path / "out").exists()


def test_files_by_their_own_headers(spark, tmp_path):
    """Any order of columns, columns besides, Label first with nulls and repeats: the same as the batch reader; what a schema lacks raises."""
    landing = tmp_path / "landing"
    a = _csv(landing, "a.csv", ["x,Label,y", "1,BENIGN,10", "2,BENIGN,20", "2,BENIGN,20"])
    b = _csv(landing, "b.csv", ["Label,y,z,x", "BENIGN,10,q,1", ",20,q,2", "DoS Hulk,30,q,inf", "No Label,NaN,q,4", "No Label,50,q,5"])
    _csv(landing, "c.csv", ["y,x,Label"])
    (landing / "d.csv").write_text("")
    schema = S.T.StructType([S.T.StructField(n, t) for n, t in (("x", S.T.DoubleType()), ("y", S.T.LongType()), ("Label", S.T.StringType()))])
    whole = S.read_files(spark, [a, b], schema)
    assert whole.columns == ["x", "y", "Label"]
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, S.read_flows(spark, a, schema).unionAll(S.read_flows(spark, b, schema)).collect()))
    seen = []

    def predict(df):
        seen.append(sorted(map(tuple, df.select("x", "y").collect())))
        assert "Label" not in df.columns
        return df.withColumn("label_predicted", F.lit("BENIGN"))

    detect.detect_files(S.stream_files(spark, f"file://{landing}"), schema, predict, ["BENIGN"], f"file://{tmp_path}/out", f"file://{tmp_path}/c", remove=[]).awaitTermination()
    assert sorted(seen) == [[], [], [(1.0, 10), (2.0, 20)], [(1.0, 10), (5.0, 50)]]
    assert sorted((r.label, r.n) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("BENIGN", 0), ("BENIGN", 0), ("BENIGN", 2), ("BENIGN", 2)]
    # without a schema types come from the file
    assert dict(S.read_files(spark, [b]).dtypes) == {"Label": "string", "y": "bigint", "z": "string", "x": "double"}
    with pytest.raises(ValueError):
        S.read_files(spark, [a, b])
    _csv(landing, "e.csv", ["x,Label", "1,BENIGN"])
    with pytest.raises(Exception, match="no such columns"):
        detect.detect_files(S.stream_files(spark, f"file://{landing}"), schema, predict, ["BENIGN"], f"file://{tmp_path}/out", f"file://{tmp_path}/c", remove=[]).awaitTermination()
    # a plain stream of rows takes columns by place, so a header in another order is an error
    with pytest.raises(Exception, match="(?i)header"):
        S.stream_flows(spark, f"file://{landing}", schema).writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/c3").trigger(availableNow=True).start().awaitTermination()


def test_detection_goes_on_by_a_period(spark, tmp_path):
    """A query with a trigger takes a file that lands while it runs, and a restart goes on after the last one."""
    landing, out = tmp_path / "landing", f"file://{tmp_path}/out"
    schema = S.T.StructType([S.T.StructField("x", S.T.LongType())])
    rule = lambda df: df.withColumn("label_predicted", F.lit("a"))
    _csv(landing, "0.csv", ["x", "1"])

    def upto(n, more=None):
        running = detect.detect_files(S.stream_files(spark, f"file://{landing}"), schema, rule, ["a"], out, f"file://{tmp_path}/c", remove=[], period="200 milliseconds")
        for _ in range(60):
            done = len(list((tmp_path / "out").glob("batch=*/_SUCCESS")))
            if done >= n or not running.isActive:
                break
            if done and more:
                _csv(landing, *more)
                more = None
            running.awaitTermination(1)
        assert running.isActive
        running.stop()
        return [r.n for r in spark.read.parquet(out).orderBy("batch_id").collect()]

    assert upto(2, ("1.csv", ["x", "1", "2"])) == [1, 2]
    _csv(landing, "2.csv", ["x", "1", "2", "3"])
    assert upto(3) == [1, 2, 3]


def test_finished_files_are_deleted(spark, tmp_path):
    landing = tmp_path / "landing"
    for i in range(3):
        _csv(landing, f"{i}.csv", ["x", "1"])
    stream = S.stream_files(spark, f"file://{landing}", finished="deleted")
    schema = S.T.StructType([S.T.StructField("x", S.T.LongType())])
    rule = lambda df: df.withColumn("label_predicted", F.lit("a"))
    detect.detect_files(stream, schema, rule, ["a"], f"file://{tmp_path}/out", f"file://{tmp_path}/c", remove=[]).awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").agg(F.sum("n")).first()[0] == 3 and len(list(landing.glob("*.csv"))) < 3


def _requests(spark, folder, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "k string, ts timestamp, duration double, status int, change int").coalesce(1).write.parquet(f"file://{folder}/f{i}")
    schema = spark.read.parquet(f"file://{folder}/f0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{folder}")


def _server(rows, kept, seconds):
    """The state of each key by plain steps, as a server keeps it."""
    from datetime import timedelta

    state = {}
    for k, ts, duration, status, change in rows:
        if ts is None:
            continue
        s = state.setdefault(k, {"total": 0, "errors": 0, "active": 0, "durations": [], "minutes": {}, "newest": ts})
        s["newest"] = max(s["newest"], ts)
        s["active"] = max(0, s["active"] + (change or 0))
        if change and change < 0:
            s["total"], s["errors"] = s["total"] + 1, s["errors"] + (status >= 400)
            s["durations"] = (s["durations"] + ([] if duration is None else [duration]))[-kept:]
            minute = ts.replace(second=0, microsecond=0)
            s["minutes"][minute] = s["minutes"].get(minute, 0) + 1
        s["minutes"] = {m: n for m, n in s["minutes"].items() if s["newest"] - m <= timedelta(seconds=seconds)}
    return {k: (s["total"], s["errors"], s["active"], sum(s["durations"]) / len(s["durations"]) if s["durations"] else 0.0, s["minutes"].get(s["newest"].replace(second=0, microsecond=0), 0), {m.strftime("%Y-%m-%d %H:%M"): n for m, n in s["minutes"].items()}) for k, s in state.items()}


@pytest.mark.parametrize("kept", [7, 250])
def test_request_state_over_micro_batches(spark, tmp_path, kept):
    """Counters, gauge, kept durations over blocks, and minutes that leave strictly after an hour, against plain steps; null rows."""
    from datetime import datetime, timedelta

    start, rng = datetime(2030, 1, 1), random.Random(4)
    rows = [("s", start + timedelta(seconds=30 * i), rng.choice([None, float(i)]), 399 + i % 2, rng.choice([1, -1, -1, None])) for i in range(400)]
    rows += [("t", start + timedelta(hours=1), 1.0, 200, -1), ("t", start, 2.0, 500, -1)]
    files = [[*rows[:150], ("s", None, 9.0, 500, -1), rows[-1]], [*rows[150:300], rows[-2]], rows[300:400]]
    stream = _requests(spark, tmp_path / "in", files)
    found = []
    q = detect.server_state(stream, "k", kept=kept).writeStream.outputMode("append").foreachBatch(lambda df, i: found.append(df.collect())).option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    done = []
    for own, got in zip(files, found, strict=False):
        done += own
        want = _server(done, kept, 3600)
        for r in got:
            if r.k == "t" and own is files[2]:
                continue  # by then the watermark is past its first minute
            assert (*tuple(r)[1:4], *tuple(r)[5:]) == (*want[r.k][:3], *want[r.k][4:]) and r.avg_duration == pytest.approx(want[r.k][3])
    assert {r.k for r in found[0]} == {"s", "t"}
    # exactly an hour after its start a minute still counts
    assert next(r for r in found[1] if r.k == "t").minutes == {"2030-01-01 00:00": 1, "2030-01-01 01:00": 1}


def test_a_silent_key_loses_its_minutes(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2030, 1, 1)
    row = lambda k, s: (k, start + timedelta(seconds=s), 1.0, 200, -1)
    stream = _requests(spark, tmp_path / "in", [[row("a", 0), row("b", 0)], [row("b", 9000)], [row("b", 9001)]])
    found = []
    detect.server_state(stream, "k", late="10 seconds").writeStream.outputMode("append").foreachBatch(lambda df, i: found.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [r.minutes for r in found if r.k == "a"] == [{"2030-01-01 00:00": 1}, {}]
    assert [(r.total_requests, len(r.minutes)) for r in found if r.k == "b"] == [(1, 1), (2, 1), (3, 1)]


def test_snapshots_over_micro_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    start, rng = datetime(2030, 1, 1), random.Random(6)
    rows = [("s", start + timedelta(seconds=90 * i), None if i % 9 == 0 else float(i), 399 + i % 2, rng.choice([1, -1, -1])) for i in range(90)]
    files = [rows[:40], [*rows[40:60], ("s", None, 1.0, 200, None)], rows[60:]]
    stream = _requests(spark, tmp_path / "in", files)
    sink = f"file://{tmp_path}/shots"
    detect.snapshots(stream, "duration", F.col("status") >= 400, ["ts"], sink, f"file://{tmp_path}/c2", change=F.col("change"), kept=10).awaitTermination()
    shots = sorted(spark.read.parquet(sink).collect(), key=lambda r: r.batch_id)
    assert [s.total_requests for s in shots] == [40, 61, 91] and shots[2].errors == 45
    assert shots[2].avg_duration == sum([r[2] for r in rows if r[2] is not None][-10:]) / 10
    active, at = 0, []
    for i, r in enumerate(rows):
        active = max(0, active + r[4])
        if i in (39, 59, 89):
            at.append(active)
    assert [s.active for s in shots] == at
    newest = rows[-1][1]
    live = {m for m in (r[1].strftime("%Y-%m-%d %H:%M") for r in rows) if (newest - datetime.strptime(m, "%Y-%m-%d %H:%M")).total_seconds() <= 3600}
    assert set(shots[2].minutes) == live and shots[2].requests_per_minute == 1
    assert sorted(p.name for p in (tmp_path / "shots" / "_state").iterdir()) == ["batch=1", "batch=2"]
    assert detect.latest_snapshot(spark, sink).first().batch_id == 2 and detect.latest_snapshot(spark, f"file://{tmp_path}/none").count() == 0


def test_monitor_goes_on_after_failures(spark, tmp_path):
    taken = []

    def sample():
        taken.append(1)
        if len(taken) == 2:
            raise OSError("no sample")
        return {"cpu_percent": 1.0, "memory_mb": 2.0}

    running = detect.monitor(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/log", f"file://{tmp_path}/c", period="200 milliseconds", sample=sample, backoff=0.1)
    for _ in range(60):
        if len(taken) > 3 or not running.isActive:
            break
        running.awaitTermination(1)
    running.stop()
    rows = sorted(spark.read.parquet(f"file://{tmp_path}/log").collect(), key=lambda r: r.at)
    assert len(rows) >= 2 and rows[0].uptime < rows[-1].uptime and {r.message for r in rows} == {"Server metrics - Requests: 0 | Active: 0 | Avg Response: 0.0000s | Rate: 0/min | Errors: 0"}
    assert '"resources":{"cpu_percent":1.0,"memory_mb":2.0}' in rows[0].status and '"active":0' in rows[0].status


def test_minutes_leave_the_state(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2030, 1, 1)
    row = lambda s: ("s", start + timedelta(seconds=s), 1.0, 200, -1)
    stream = _requests(spark, tmp_path / "in", [[row(0), row(30)], [row(8000)], [row(8001)], [row(10), row(8010)]])
    kept = []
    detect.minute_counts(stream).writeStream.outputMode("append").foreachBatch(lambda df, i: kept.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in kept] == [("2030-01-01 00:00", 2)]  # a late row for a closed minute doesn't reopen it


def test_live_minutes_edges(spark):
    minutes = spark.createDataFrame([("2030-01-01 00:00", 1), ("2030-01-01 00:01", 2)], "minute string, requests long")
    for now, n in (("2030-01-01 01:00:00", 2), ("2030-01-01 01:00:01", 1)):
        assert metrics.live_minutes(minutes, F.lit(now).cast("timestamp")).count() == n


def test_logs_json_and_status(spark):
    df = spark.createDataFrame([("2030-01-01 10:00:00,123 - INFO - a - b",), ("2030-01-01 10:00:00 - ERROR - x",), ("junk",)], "value string")
    assert [(r.level, r.message) for r in S.parse_log(df).collect()] == [("INFO", "a - b"), ("ERROR", "x"), (None, None)]
    shot = spark.createDataFrame([(3, 1, 0.12345, 2, 0)], "total_requests long, active long, avg_duration double, requests_per_minute long, errors long")
    assert shot.select(S.metrics_message(shot)).first()[0] == "Server metrics - Requests: 3 | Active: 1 | Avg Response: 0.1235s | Rate: 2/min | Errors: 0"
    bodies = spark.createDataFrame([('{"k": 1}',), ("not json",), (None,)], "b string").select(X.echo_body(X.tolerant_json(F.col("b"), "k long")).alias("x")).collect()
    assert [r.x for r in bodies] == ['{"received":{"k":1},"status":"ok"}'] + ['{"received":{},"status":"ok"}'] * 2
    sample = detect.resources(0.01)
    assert sample["memory_mb"] > 1 and sample["cpu_percent"] >= 0
    empty = spark.createDataFrame([], "ts timestamp, value double")
    assert tuple(metrics.snapshot(empty, "value", F.lit(False), ["ts"]).first()) == (0, 0, 0.0, 0)


def test_a_table_may_be_a_folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/lineitem.parquet").repartition(3).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    rows = registry.stream_detect(spark, f"file://{tmp_path}").collect()
    assert {r.batch_id for r in rows} == {0} and sorted(map(tuple, rows)) == sorted(map(tuple, registry.stream_detect(spark, SF).collect()))


def test_cuts_are_deleted_when_nothing_reads_them(spark):
    """Checkpoints of a tree's growth leave the shared folder after the frames are gone."""
    import gc
    import time
    from pathlib import Path
    from urllib.parse import urlparse

    from weirflow import storage

    storage.shared_dir(spark)
    folder = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    before = {p.name for p in folder.iterdir()}
    held = storage.cut(spark.range(10))
    kept = {p.name for p in folder.iterdir()} - before
    cut = storage.cut(spark.range(20))
    df = spark.createDataFrame([(float(i % 7), "ab"[i % 2]) for i in range(60)], "f double, y string")
    nodes = tree.Tree(max_depth=3).fit(df, ["f"], "y")
    assert kept and kept < {p.name for p in folder.iterdir()} - before and cut.count() == 20 and nodes.count() > 0
    del cut, nodes
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
        if {p.name for p in folder.iterdir()} - before <= kept:
            break
    assert {p.name for p in folder.iterdir()} - before == kept and held.count() == 10
