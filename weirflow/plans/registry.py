"""Queries of the flow and request operators on the driver's tables, each with its SQL where SQL can say it.

lineitem stands for flows (four features, label l_returnflag), events for requests (value is the
duration, 'error' an error status).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import programs
from ..functions import features as X
from ..operators import analyze, clean, evaluate, forest, metrics, split, tree
from ..sources import flows as S
from ..storage import cut, remove, small, table_path
from ..streaming import detect
from .flagship import FEATURES, flagship, flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CLASSES = ["A", "N", "R"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY ALL")
def scan_project(spark, d):
    rows = clean.drop_columns(_t(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"])
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_tax"), 4).alias("tax"))


def _with_inf(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    return rows.withColumns({"rate": F.when(F.col("l_tax") == 0, float("inf")).otherwise(F.col("l_quantity") / F.when(F.col("l_tax") != 0, F.col("l_tax"))), "share": F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_discount"))})


_INF = "(SELECT l_returnflag, l_quantity, CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END AS rate, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS share FROM lineitem)"


@query(f"SELECT l_returnflag, count(*) AS n, count(rate) AS n_rate, count(share) AS n_share, round(sum(rate), 1) AS rate FROM {_INF} GROUP BY ALL")
def clean_inf(spark, d):
    return clean.infinite_to_null(_with_inf(spark, d)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("rate").alias("n_rate"), F.count("share").alias("n_share"), F.round(F.sum("rate"), 1).alias("rate"))


@query(f"SELECT l_returnflag, count(*) AS n, round(sum(share), 3) AS share FROM {_INF} WHERE rate IS NOT NULL AND share IS NOT NULL GROUP BY ALL")
def clean_dropna(spark, d):
    return clean.drop_any_null(clean.infinite_to_null(_with_inf(spark, d))).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("share"), 3).alias("share"))


@query(f"SELECT * FROM (SELECT 'rate' AS \"column\", count(*) - count(rate) AS n_null FROM {_INF} UNION ALL SELECT 'share', count(*) - count(share) FROM {_INF}) WHERE n_null > 0")
def null_counts(spark, d):
    return clean.null_counts(clean.infinite_to_null(_with_inf(spark, d)))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_tax FROM lineitem")
def dedup(spark, d):
    return _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_tax").dropDuplicates()


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY ALL")
def label_filter(spark, d):
    return clean.keep_labels(_t(spark, d, "events"), "event_type", ["error", "click"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_tax, round(l_tax / CASE WHEN l_discount = 0 THEN 0.1 ELSE l_discount END, 8) AS ratio,
          round(l_quantity / CASE WHEN l_tax = 0 THEN 1 ELSE l_tax END, 6) AS unit_ratio FROM lineitem""")
def safe_ratio(spark, d):
    c = F.col
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.round(X.safe_ratio(c("l_tax"), c("l_discount")), 8).alias("ratio"), F.round(X.safe_ratio(c("l_quantity"), c("l_tax"), 1.0), 6).alias("unit_ratio"))


@query("SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, 0) + coalesce(l_extendedprice, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0), 4) AS total FROM lineitem")
def row_sum(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.row_sum([F.col(c) for c in NUM]), 4).alias("total"))


@query("SELECT l_orderkey, l_linenumber, (l_quantity > 0)::INT + (l_extendedprice > 0)::INT + (l_discount > 0)::INT + (l_tax > 0)::INT AS positive FROM lineitem")
def row_count_pos(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.count_positive([F.col(c) for c in NUM]).alias("positive"))


@query(r"""SELECT event_id, CASE WHEN regexp_matches(k, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') THEN TRY_CAST(k AS DOUBLE) END AS k,
          CASE WHEN regexp_matches(event_type, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') THEN TRY_CAST(event_type AS DOUBLE) END AS bad
          FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)""")
def coerce_numeric(spark, d):
    return _t(spark, d, "events").select("event_id", X.coerce_numeric(F.get_json_object("props", "$.k")).alias("k"), X.coerce_numeric(F.col("event_type")).alias("bad"))


@query(f"SELECT l_returnflag, round(sum(coalesce(rate, 0)), 1) AS rate, round(avg(coalesce(share, 0)), 6) AS share FROM {_INF} GROUP BY ALL")
def fill_zero(spark, d):
    return clean.infinite_to_null(_with_inf(spark, d)).na.fill(0).groupBy("l_returnflag").agg(F.round(F.sum("rate"), 1).alias("rate"), F.round(F.avg("share"), 6).alias("share"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS price32 FROM lineitem")
def float32_cast(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", X.float32(F.col("l_extendedprice")).alias("price32"))


@query("""SELECT feature, round(variance, 8) AS variance FROM (SELECT 'l_quantity' AS feature, var_samp(l_quantity) AS variance FROM lineitem UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem
          UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', var_samp(l_tax) FROM lineitem) WHERE variance < 0.01""")
def low_variance(spark, d):
    return analyze.low_variance(_t(spark, d, "lineitem"), NUM).select("feature", F.round("variance", 8).alias("variance"))


#: Derived columns with nulls in different rows.
_NET = "(SELECT *, CASE WHEN l_linenumber <> 2 THEN l_extendedprice * (1 - l_discount) END AS net, CASE WHEN l_discount <= 0.05 THEN -l_extendedprice END AS owed FROM lineitem)"


def _net(spark, d):
    net, owed = F.col("l_extendedprice") * (1 - F.col("l_discount")), -F.col("l_extendedprice")
    return _t(spark, d, "lineitem").select(*NUM, F.when(F.col("l_linenumber") != 2, net).alias("net"), F.when(F.col("l_discount") <= 0.05, owed).alias("owed"))


def _pairs_sql(cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{cols[j]}' AS feature_a, '{cols[i]}' AS feature_b, corr({cols[j]}, {cols[i]}) AS r FROM {_NET}" for j in range(len(cols)) for i in range(j))


_COLS = ["l_quantity", "l_extendedprice", "l_tax", "net", "owed"]


@query(f"SELECT feature_a, feature_b, round(r, 6) AS r FROM ({_pairs_sql(_COLS)}) WHERE abs(r) > 0.95")
def high_corr(spark, d):
    return analyze.correlations(_net(spark, d), _COLS).where(F.abs("r") > 0.95).select("feature_a", "feature_b", F.round("r", 6).alias("r"))


@query(f"""SELECT feature FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_tax'), ('net'), ('owed')) f(feature)
          WHERE feature NOT IN (SELECT feature_a FROM ({_pairs_sql(_COLS)}) WHERE r > 0.95)
          AND NOT (feature = 'l_tax' AND (SELECT var_samp(l_tax) FROM lineitem) < 0.01)""")
def feature_keep(spark, d):
    return spark.createDataFrame([(c,) for c in analyze.kept_features(_net(spark, d), _COLS)], "feature string")


@query("SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code, (SELECT count(DISTINCT event_type) FROM events) AS n_classes FROM (SELECT DISTINCT event_type FROM events)")
def label_index(spark, d):
    rows = _t(spark, d, "events")
    return forest.label_index(rows, "event_type").crossJoin(F.broadcast(rows.agg(F.countDistinct("event_type").alias("n_classes"))))


@query("""SELECT label, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type AS label FROM events UNION SELECT 'absent') LEFT JOIN (SELECT event_type AS label, count(*) AS n FROM events GROUP BY ALL) USING (label)""")
def label_counts_zero_fill(spark, d):
    return evaluate.label_counts(_t(spark, d, "events").select(F.col("event_type").alias("label")), "label", ["absent"])


@query("""SELECT l_linestatus, l_returnflag, count(*)::DOUBLE AS weight, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 8) AS share FROM lineitem GROUP BY l_linestatus, l_returnflag""")
def class_hist(spark, d):
    return split.class_histogram(_t(spark, d, "lineitem"), "l_linestatus", "l_returnflag").withColumn("share", F.round("share", 8))


@query("SELECT l_linestatus, round(1 - sum(n * n) / (sum(n) * sum(n)), 8) AS gini, sum(n)::BIGINT AS n FROM (SELECT l_linestatus, l_returnflag, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL) GROUP BY ALL")
def gini(spark, d):
    return split.gini(_t(spark, d, "lineitem"), "l_linestatus", "l_returnflag").withColumn("gini", F.round("gini", 8))


@query("SELECT * FROM (SELECT l_linestatus, v AS l_quantity, lead(v) OVER (PARTITION BY l_linestatus ORDER BY v) AS next_value FROM (SELECT DISTINCT l_linestatus, l_quantity AS v FROM lineitem)) WHERE next_value - l_quantity > 1e-7")
def adjacent_values(spark, d):
    return split.adjacent_values(_t(spark, d, "lineitem"), ["l_linestatus"], "l_quantity")


_SPLIT = """WITH v AS (SELECT l_linestatus, l_extendedprice AS x, count(*) FILTER (l_returnflag = 'A')::DOUBLE a, count(*) FILTER (l_returnflag = 'N')::DOUBLE b, count(*) FILTER (l_returnflag = 'R')::DOUBLE c FROM lineitem GROUP BY ALL),
 w AS (SELECT *, lead(x) OVER o AS y, sum(a) OVER (o ROWS UNBOUNDED PRECEDING) la, sum(b) OVER (o ROWS UNBOUNDED PRECEDING) lb, sum(c) OVER (o ROWS UNBOUNDED PRECEDING) lc,
  sum(a) OVER p ta, sum(b) OVER p tb, sum(c) OVER p tc FROM v WINDOW o AS (PARTITION BY l_linestatus ORDER BY x), p AS (PARTITION BY l_linestatus)),
 s AS (SELECT *, la + lb + lc AS nl, ta + tb + tc AS n, ta + tb + tc - la - lb - lc AS nr, (la*la + lb*lb + lc*lc) AS ql, (ta-la)*(ta-la) + (tb-lb)*(tb-lb) + (tc-lc)*(tc-lc) AS qr, ta*ta + tb*tb + tc*tc AS q FROM w WHERE y - x > 1e-7),
 b AS (SELECT *, ql / nl + qr / nr AS proxy, row_number() OVER (PARTITION BY l_linestatus ORDER BY ql / nl + qr / nr DESC, x) AS k FROM s) """


def _best(spark, d):
    return split.best_split(split.split_candidates(_t(spark, d, "lineitem"), "l_linestatus", ["l_extendedprice"], "l_returnflag", CLASSES), "l_linestatus")


@query(_SPLIT + "SELECT l_linestatus, round(x / 2 + y / 2, 6) AS threshold, nl, nr, round(proxy, 4) AS proxy FROM b WHERE k = 1")
def best_split(spark, d):
    return _best(spark, d).select("l_linestatus", F.round("threshold", 6).alias("threshold"), "nl", "nr", F.round("proxy", 4).alias("proxy"))


@query(_SPLIT + "SELECT l_linestatus, round(n / (SELECT count(*) FROM lineitem) * ((1 - q / (n * n)) - nr / n * (1 - qr / (nr * nr)) - nl / n * (1 - ql / (nl * nl))), 8) AS gain FROM b WHERE k = 1")
def split_gain(spark, d):
    total = _t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("_all"))
    return _best(spark, d).crossJoin(F.broadcast(total)).select("l_linestatus", F.round(split.gain(F.col("_all")), 8).alias("gain"))


@query(_SPLIT + "SELECT l.l_linestatus, CASE WHEN l.l_extendedprice <= b.x / 2 + b.y / 2 THEN 0 ELSE 1 END AS side, count(*) AS n FROM lineitem l JOIN b ON l.l_linestatus = b.l_linestatus AND b.k = 1 GROUP BY ALL")
def node_route(spark, d):
    best = small(cut(_best(spark, d).select("l_linestatus", "threshold")))
    rows = _t(spark, d, "lineitem").join(best, "l_linestatus")
    return split.route(rows, F.col("l_extendedprice"), F.col("threshold")).groupBy("l_linestatus", "side").agg(F.count(F.lit(1)).alias("n"))


def _xorshift_sql(x: str) -> str:
    """One step over the column x, modulo 2**31, as a chain of subqueries' expressions."""
    a = f"(CASE WHEN ({x}) = 0 THEN 1 ELSE ({x}) END & 4294967295)"
    b = f"(xor({a}, {a} << 13) & 4294967295)"
    c = f"xor({b}, {b} >> 17)"
    return f"((xor({c}, {c} << 5) & 4294967295) % 2147483648)"


def _draws_sql(trees: int, slots: str) -> str:
    first = f"SELECT tree_id, {_xorshift_sql('(slot * 40503 + tree_id * 69069 + 42) & 4294967295')} AS r FROM range({trees}) t(tree_id), (SELECT unnest(range({slots})) AS slot)"
    return f"""WITH d AS (SELECT tree_id, {_xorshift_sql('r * 2 + 1')} % (SELECT count(*) FROM orders) AS row FROM ({first})), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders)
 SELECT tree_id::INT AS tree_id, o_orderkey, count(*) AS times FROM d JOIN o USING (row) GROUP BY ALL"""


@query(_draws_sql(1, "(SELECT round(count(*) * 0.5)::BIGINT FROM orders)"))
def bootstrap(spark, d):
    return forest.bootstrap(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], max_samples=0.5)


@query(_draws_sql(2, "(SELECT count(*) FROM orders)"))
def bootstrap_draw(spark, d):
    return forest.bootstrap(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], trees=2)


@query("""WITH a AS (SELECT event_id, CASE WHEN event_id = 0 THEN 1 ELSE event_id END & 4294967295 AS x FROM events), b AS (SELECT event_id, xor(x, x << 13) & 4294967295 AS x FROM a),
 c AS (SELECT event_id, xor(x, x >> 17) AS x FROM b), e AS (SELECT event_id, xor(x, x << 5) & 4294967295 AS x FROM c) SELECT event_id, x % 2147483648 AS r FROM e""")
def xorshift(spark, d):
    return _t(spark, d, "events").select("event_id", X.xorshift32(F.col("event_id")).alias("r"))


def _ruled(spark, d):
    return _t(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_discount") > 0.05, "A").otherwise("R").alias("predicted"))


_RULED = "(SELECT l_returnflag AS y, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_discount > 0.05 THEN 'A' ELSE 'R' END AS p FROM lineitem)"


@query(f"SELECT y AS l_returnflag, count(*) FILTER (p = 'A') AS \"pred_A\", count(*) FILTER (p = 'N') AS \"pred_N\", count(*) FILTER (p = 'R') AS \"pred_R\" FROM {_RULED} GROUP BY ALL")
def confusion(spark, d):
    return evaluate.confusion(_ruled(spark, d), "l_returnflag", "predicted", CLASSES)


@query(f"""WITH c AS (SELECT c AS class, (SELECT count(*) FROM {_RULED} WHERE y = c AND p = c) AS hit, (SELECT count(*) FROM {_RULED} WHERE p = c) AS called, (SELECT count(*) FROM {_RULED} WHERE y = c) AS support FROM (VALUES ('A'), ('N'), ('R')) v(c)),
 m AS (SELECT *, coalesce(hit / nullif(called, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM c), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
 SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM f
 UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM f
 UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
 UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f""")
def class_report(spark, d):
    found = evaluate.class_report(_ruled(spark, d), "l_returnflag", "predicted")
    return found.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


#: Two exact trees of depth 2 over lineitem: one of all rows and features, one of the open lines without the price.
_GROWN = ((0, "true", [0, 1, 2, 3]), (1, "l_linestatus = 'F'", [0, 2, 3]))


def _grown_sql(tree: int, where: str, places: list[int]) -> str:
    """CTEs of one tree, grown twice by the same steps: counts of values, running sums, the best threshold of each node."""
    t, x = f"t{tree}", ", ".join(f"{NUM[p]}::FLOAT::DOUBLE" for p in places)

    def level(name: str, rows: str) -> str:
        long = " UNION ALL ".join(f"SELECT node, {p} AS place, x[{i + 1}] AS v, y FROM {rows}" for i, p in enumerate(places))
        return f"""{name}_v AS (SELECT node, place, v, count(*) FILTER (y = 'A')::DOUBLE a, count(*) FILTER (y = 'N')::DOUBLE b, count(*) FILTER (y = 'R')::DOUBLE c FROM ({long}) GROUP BY ALL),
 {name}_w AS (SELECT *, lead(v) OVER o AS z, sum(a) OVER (o ROWS UNBOUNDED PRECEDING) la, sum(b) OVER (o ROWS UNBOUNDED PRECEDING) lb, sum(c) OVER (o ROWS UNBOUNDED PRECEDING) lc, sum(a) OVER p ta, sum(b) OVER p tb, sum(c) OVER p tc FROM {name}_v WINDOW o AS (PARTITION BY node, place ORDER BY v), p AS (PARTITION BY node, place)),
 {name}_s AS (SELECT *, la + lb + lc AS nl, ta + tb + tc AS n, ta + tb + tc - (la + lb + lc) AS nr FROM {name}_w WHERE z - v > 1e-7),
 {name}_k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY (la*la + lb*lb + lc*lc) / nl + ((ta-la)*(ta-la) + (tb-lb)*(tb-lb) + (tc-lc)*(tc-lc)) / nr DESC, place, v) AS k FROM {name}_s),
 {name} AS (SELECT node, place, v / 2 + z / 2 AS threshold, la, lb, lc, ta - la AS ra, tb - lb AS rb, tc - lc AS rc, nl, nr, n, 1 - (ta*ta + tb*tb + tc*tc) / (n * n) AS impurity FROM {name}_k WHERE k = 1 AND ta*ta + tb*tb + tc*tc < n * n)"""

    at = "x[" + "CASE place " + " ".join(f"WHEN {p} THEN {i + 1}" for i, p in enumerate(places)) + " END]"
    half = lambda s: f"(1 - ({s}a*{s}a + {s}b*{s}b + {s}c*{s}c) / (n{s} * n{s}))"
    inner = lambda k, own: f"SELECT {own} AS path, place AS feature, threshold, impurity, n, ta AS a, tb AS b, tc AS c FROM (SELECT *, la + ra AS ta, lb + rb AS tb, lc + rc AS tc FROM {k})"
    leaf = lambda k, own, s: f"SELECT {own} AS path, -2, -2.0, {half(s)}, n{s}, {s}a, {s}b, {s}c FROM {k}"
    return f"""{t}_r AS (SELECT 0 AS node, [{x}] AS x, l_returnflag AS y FROM lineitem WHERE {where}), {level(t + "_0", t + "_r")},
 {t}_q AS (SELECT CASE WHEN {at} <= threshold THEN 1 ELSE 2 END AS node, x, y FROM {t}_r, (SELECT place, threshold FROM {t}_0)), {level(t + "_1", t + "_q")},
 {t}_p AS ({inner(t + "_0", "''")} UNION ALL {inner(t + "_1", "node::VARCHAR")} UNION ALL {leaf(t + "_0", "'1'", "l")} WHERE NOT EXISTS (SELECT 1 FROM {t}_1 WHERE node = 1) UNION ALL {leaf(t + "_0", "'2'", "r")} WHERE NOT EXISTS (SELECT 1 FROM {t}_1 WHERE node = 2)
  UNION ALL {leaf(t + "_1", "node || '1'", "l")} UNION ALL {leaf(t + "_1", "node || '2'", "r")}),
 {t}_i AS (SELECT *, (row_number() OVER (ORDER BY path) - 1)::INT AS node_id FROM {t}_p),
 {t}_n AS (SELECT {tree} AS tree_id, i.node_id, coalesce(l.node_id, -1) AS l, coalesce(r.node_id, -1) AS r, i.feature, i.threshold, i.impurity, i.n, [i.a / i.n, i.b / i.n, i.c / i.n] AS value,
  coalesce(i.n * i.impurity - l.n * l.impurity - r.n * r.impurity, 0) AS decrease FROM {t}_i i LEFT JOIN {t}_i l ON l.path = i.path || '1' LEFT JOIN {t}_i r ON r.path = i.path || '2')"""


_TREES = f"WITH RECURSIVE {', '.join(_grown_sql(*g) for g in _GROWN)}, n AS (SELECT * FROM t0_n UNION ALL SELECT * FROM t1_n)"
_DESCENT = f"""{_TREES}, x AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, [{', '.join(f"{c}::FLOAT::DOUBLE" for c in NUM)}] AS x FROM lineitem),
 w AS (SELECT id, l_orderkey, l_linenumber, x, tree_id, 0 AS node_id FROM x, (SELECT DISTINCT tree_id FROM n) UNION ALL
  SELECT w.id, w.l_orderkey, w.l_linenumber, w.x, w.tree_id, CASE WHEN w.x[n.feature + 1] <= n.threshold THEN n.l ELSE n.r END FROM w JOIN n ON w.tree_id = n.tree_id AND w.node_id = n.node_id WHERE n.l >= 0),
 leaf AS (SELECT id, l_orderkey, l_linenumber, w.tree_id, w.node_id, n.value FROM w JOIN n ON w.tree_id = n.tree_id AND w.node_id = n.node_id WHERE n.l < 0) """
_IMPORTANCE = f"""{_TREES}, t AS (SELECT tree_id, feature, sum(decrease) / sum(sum(decrease)) OVER (PARTITION BY tree_id) AS importance FROM n WHERE l >= 0 GROUP BY tree_id, feature),
 f AS (SELECT feature, sum(importance) / (SELECT count(DISTINCT tree_id) FROM t) AS importance FROM t GROUP BY feature) """


def _grown(spark, d) -> DataFrame:
    """The nodes of the two trees, with features by their place in NUM."""
    rows, tables = _t(spark, d, "lineitem"), []
    for number, where, places in _GROWN:
        nodes = tree.Tree(max_depth=2).fit(rows.where(where), [NUM[p] for p in places], "l_returnflag")
        place = F.get(F.array(*map(F.lit, places)), F.when(F.col("feature") >= 0, F.col("feature")))
        tables.append(nodes.withColumns({"tree_id": F.lit(number), "feature": F.coalesce(place, F.lit(-2))}))
    return tables[0].unionAll(tables[1])


def _line(rows: DataFrame) -> DataFrame:
    """lineitem with one key of a line."""
    return rows.withColumn("line", F.col("l_orderkey") * 100 + F.col("l_linenumber"))


@query(_DESCENT + "SELECT l_orderkey * 100 + l_linenumber AS line, tree_id, node_id FROM leaf")
def tree_descend(spark, d):
    return forest.descend(_line(_t(spark, d, "lineitem")), _grown(spark, d), "line", NUM)


@query(_DESCENT + "SELECT l_orderkey * 100 + l_linenumber AS line, tree_id, round(value[1], 8) AS p0, round(value[2], 8) AS p1, round(value[3], 8) AS p2 FROM leaf")
def tree_predict_proba(spark, d):
    nodes = _grown(spark, d)
    leaves = forest.descend(_line(_t(spark, d, "lineitem")), nodes, "line", NUM)
    return forest.leaf_values(leaves, nodes).select("line", "tree_id", *[F.round(F.col("value")[i], 8).alias(f"p{i}") for i in range(3)])


@query(_DESCENT + ", m AS (SELECT id, l_orderkey, l_linenumber, avg(value[1]) AS p0, avg(value[2]) AS p1, avg(value[3]) AS p2 FROM leaf GROUP BY ALL) SELECT l_orderkey, l_linenumber, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'A' WHEN p1 >= p2 THEN 'N' ELSE 'R' END AS label_predicted FROM m")
def forest_vote(spark, d):
    votes = forest.score_nodes(_t(spark, d, "lineitem"), _grown(spark, d), NUM, CLASSES)
    return votes.select("l_orderkey", "l_linenumber", *[F.round(f"p{i}", 6).alias(f"p{i}") for i in range(3)], "label_predicted")


@query(_TREES + " SELECT tree_id, node_id, l AS \"left\", r AS \"right\", feature, round(threshold, 6) AS threshold, round(impurity, 8) AS impurity, n::BIGINT AS n_node_samples, round(decrease, 4) AS decrease FROM n")
def exact_nodes(spark, d):
    """Two exact trees of depth 2, node by node."""
    return _grown(spark, d).select("tree_id", "node_id", "left", "right", "feature", *[F.round(c, k).alias(c) for c, k in (("threshold", 6), ("impurity", 8))], "n_node_samples", F.round("decrease", 4).alias("decrease"))


@query(_IMPORTANCE + "SELECT tree_id, feature, round(importance, 8) AS importance FROM t")
def tree_importance(spark, d):
    return forest.tree_importance(_grown(spark, d)).withColumn("importance", F.round("importance", 8))


@query(_IMPORTANCE + "SELECT feature, round(importance, 8) AS importance FROM f WHERE importance >= 0.3")
def importance_select(spark, d):
    return analyze.select_by_importance(forest.forest_importance(_grown(spark, d)), 0.3).withColumn("importance", F.round("importance", 8))


@query(_IMPORTANCE + "SELECT feature, round(importance, 8) AS importance FROM f ORDER BY f.importance DESC, feature LIMIT 2")
def top_n(spark, d):
    return forest.forest_importance(_grown(spark, d)).orderBy(F.desc("importance"), "feature").limit(2).withColumn("importance", F.round("importance", 8))


def model_nodes(spark, d):
    """MLlib's trees are drawn at random, so there is no SQL; tests hold the table against the model's own predictions."""
    model, _ = forest.fit_forest(flows(spark, d), FEATURES, "l_returnflag", n_estimators=3, max_depth=4)
    return forest.node_table(spark, model)


QUERIES["model_nodes"] = model_nodes
QUERIES["forest_train_predict"] = flagship


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS requests FROM events GROUP BY ALL")
def req_per_minute(spark, d):
    return metrics.requests_per_minute(_t(spark, d, "events"))


@query("SELECT round(coalesce(avg(value), 0), 6) AS avg_duration, count(*) AS n FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)")
def last_n_avg(spark, d):
    return metrics.last_n_average(_t(spark, d, "events"), "value", ["ts", "event_id"]).withColumn("avg_duration", F.round("avg_duration", 6))


@query("SELECT event_id, event_type, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 999 PRECEDING) + 1e-9, 5) AS rolling_avg FROM events")
def rolling_avg(spark, d):
    return metrics.rolling_average(_t(spark, d, "events"), ["event_type"], "value", ["ts", "event_id"]).select("event_id", "event_type", F.round(F.col("rolling_avg") + 1e-9, 5).alias("rolling_avg"))


@query("""SELECT minute, requests, age FROM (SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS requests, (epoch((SELECT max(ts) FROM events))::BIGINT - epoch(date_trunc('minute', min(ts)))::BIGINT) AS age FROM events GROUP BY 1) WHERE age <= 3600""")
def state_ttl(spark, d):
    rows = _t(spark, d, "events")
    # the nearest second, as the SQL's cast gives it
    now = rows.agg(F.timestamp_seconds(F.rint(F.unix_micros(F.max("ts").cast("timestamp")) / 1e6).cast("long")).alias("_now"))
    minutes = metrics.requests_per_minute(rows).crossJoin(F.broadcast(now))
    return metrics.live_minutes(minutes, F.col("_now")).select("minute", "requests", "age")


@query("""WITH g AS (SELECT event_id, user_id, ts, sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS gauge FROM events)
 SELECT event_id, gauge, gauge - least(0, min(gauge) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS active FROM g""")
def active_gauge(spark, d):
    change = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    return metrics.running_gauge(_t(spark, d, "events"), ["user_id"], change, ["ts", "event_id"]).select("event_id", "gauge", "active")


_SNAPSHOT = """SELECT count(*) AS total_requests, count(*) FILTER (event_type = 'error') AS errors, (SELECT round(avg(value), 6) FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)) AS avg_duration,
 (SELECT count(*) FROM events WHERE date_trunc('minute', ts) = (SELECT max(date_trunc('minute', ts)) FROM events)) AS requests_per_minute FROM events"""


@query(_SNAPSHOT)
def metrics_snapshot(spark, d):
    return metrics.snapshot(_t(spark, d, "events"), "value", F.col("event_type") == "error", ["ts", "event_id"]).withColumn("avg_duration", F.round("avg_duration", 6))


@query("SELECT '2031-01-01 00:00' AS minute, 0::BIGINT AS requests UNION ALL SELECT strftime(max(ts), '%Y-%m-%d %H:%M'), (SELECT count(*) FROM events WHERE date_trunc('minute', ts) = (SELECT max(date_trunc('minute', ts)) FROM events)) FROM events")
def current_minute(spark, d):
    rows = _t(spark, d, "events")
    now = rows.agg(F.max("ts")).first()[0]
    return metrics.current_minute(rows, F.lit("2031-01-01 00:00:30").cast("timestamp_ntz")).unionAll(metrics.current_minute(rows, F.lit(now)))


@query(f"""SELECT '{{"status":"running","uptime":12.5,"metrics":{{"total_requests":' || total_requests || ',"errors":' || errors || ',"requests_per_minute":' || requests_per_minute || '}},"resources":{{"cpu_percent":0.0,"memory_mb":64.0}}}}' AS status FROM ({_SNAPSHOT})""")
def status_json(spark, d):
    shot = metrics.snapshot(_t(spark, d, "events"), "value", F.col("event_type") == "error", ["ts", "event_id"]).drop("avg_duration")
    uptime = X.elapsed_seconds(F.lit("2030-01-01 00:00:00").cast("timestamp"), F.lit("2030-01-01 00:00:12.5").cast("timestamp"))
    return metrics.status_json(shot, uptime, F.struct(F.lit(0.0).alias("cpu_percent"), F.lit(64.0).alias("memory_mb")))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'f' || user_id END, CASE WHEN event_id % 2 = 0 THEN 'p' || user_id END, 'none') AS client FROM events")
def first_header(spark, d):
    c = F.col
    forwarded, peer = F.when(c("event_id") % 3 == 0, F.concat(F.lit("f"), c("user_id"))), F.when(c("event_id") % 2 == 0, F.concat(F.lit("p"), c("user_id")))
    return _t(spark, d, "events").select("event_id", X.first_header(forwarded, peer, F.lit("none")).alias("client"))


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1e6, 6) AS seconds FROM events")
def elapsed(spark, d):
    return _t(spark, d, "events").select("event_id", F.round(X.elapsed_seconds(F.date_trunc("day", "ts").cast("timestamp"), F.col("ts").cast("timestamp")), 6).alias("seconds"))


@query("SELECT event_id, '{\"received\":{\"k\":' || json_extract_string(props, '$.k') || '},\"status\":\"ok\"}' AS body FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL UNION ALL SELECT event_id, '{\"received\":{},\"status\":\"ok\"}' FROM events WHERE json_extract_string(props, '$.k') IS NULL")
def json_echo(spark, d):
    return _t(spark, d, "events").select("event_id", X.echo_body(X.tolerant_json(F.col("props"), "k long")).alias("body"))


@query("SELECT event_id, least(value * 7, 10.0) AS delay FROM events")
def clamp_float(spark, d):
    return _t(spark, d, "events").select("event_id", X.clamp_param((F.col("value") * 7).cast("string"), 10.0, "double").alias("delay"))


@query("SELECT event_id, least(coalesce(CAST(json_extract_string(props, '$.k') AS INT), 1), 10) AS seconds FROM events")
def clamp_param(spark, d):
    return _t(spark, d, "events").select("event_id", X.clamp_param(F.get_json_object("props", "$.k")).alias("seconds"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'took ' || printf('%.3f', value) AS message FROM events")
def log_parse(spark, d):
    level, message = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.concat(F.lit("took "), F.format_string("%.3f", "value"))
    lines = _t(spark, d, "events").select("event_id", S.log_line(F.col("ts"), level, message).alias("value"))
    return S.parse_log(lines).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "level", "message")


def _streamed(spark, d, name, run) -> DataFrame:
    """What run(stream, sink, checkpoint) leaves in a fresh sink of the shared folder, from a table read as a stream to its end."""
    base = table_path(spark, "stream")
    run(S.stream_table(spark, f"{d}/{name}.parquet"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    remove(spark, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@query("SELECT 0::BIGINT AS batch_id, label, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'A' END AS label, 1 AS n FROM (SELECT DISTINCT * FROM lineitem) UNION ALL SELECT unnest(['A', 'N', 'R']), 0) GROUP BY ALL")
def stream_detect(spark, d):
    """The table as one micro-batch; a rule stands for the model so that counts are known."""
    rule = lambda df: df.withColumn("label_predicted", F.when(F.col("l_linestatus") == "O", "N").otherwise("A"))
    found = _streamed(spark, d, "lineitem", lambda s, sink, at: detect.detect(s, rule, CLASSES, sink, at, remove=["l_orderkey", "l_partkey"]))
    return found.select(F.col("batch_id").cast("long").alias("batch_id"), "label", "n")


def _thirds(spark, d) -> str:
    """A folder of the shared one with events in three files, in the order of their time."""
    path, rows = table_path(spark, "thirds"), _t(spark, d, "events")
    lo, hi = rows.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    third = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - lo) * 3 / (hi - lo + 1)), F.lit(2))
    for i in range(3):  # one after another: a stream takes older files first
        rows.where(third == i).coalesce(1).write.parquet(f"{path}/part={i}")
    return path


_VOTED = """, m AS (SELECT id, avg(value[1]) AS p0, avg(value[2]) AS p1, avg(value[3]) AS p2 FROM leaf GROUP BY id),
 c AS (SELECT CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'A' WHEN p1 >= p2 THEN 'N' ELSE 'R' END AS label, 1 AS n FROM m UNION ALL SELECT unnest(['A', 'N', 'R', 'none']), 0)
 SELECT 0::BIGINT AS batch_id, label, sum(n)::BIGINT AS n FROM c GROUP BY label"""


@query(_DESCENT.replace("AS x FROM lineitem)", "AS x FROM (SELECT DISTINCT * FROM lineitem))") + _VOTED)
def stream_scores(spark, d):
    """Detection with a model: a micro-batch is cleaned, scored by two exact trees and counted for each label."""
    nodes = _grown(spark, d)
    predict = lambda df: forest.score_nodes(df, nodes, NUM, CLASSES)
    found = _streamed(spark, d, "lineitem", lambda s, sink, at: detect.detect(s, predict, [*CLASSES, "none"], sink, at, remove=["l_orderkey", "l_partkey"]))
    return found.select(F.col("batch_id").cast("long").alias("batch_id"), "label", "n")


def _in_thirds(spark, d) -> tuple[DataFrame, str]:
    """events as a stream of three micro-batches, and the folder that it reads."""
    source = _thirds(spark, d)
    stream = spark.readStream.schema(spark.read.parquet(f"{source}/part=0").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    return stream, source


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS requests FROM events GROUP BY ALL")
def stream_minutes(spark, d):
    """The last count of each minute over three micro-batches; a minute that the watermark has passed is out of the state."""
    base, (stream, source) = table_path(spark, "stream"), _in_thirds(spark, d)
    keep = lambda df, batch_id: df.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/out")
    detect.minute_counts(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    remove(spark, source, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("minute").agg(F.max_by("requests", "batch").alias("requests"))


@query("SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS requests FROM events GROUP BY date_trunc('minute', ts) HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_closed_minutes(spark, d):
    """The minutes that have left the state: each is given once, when the watermark, an hour behind the latest request, is past its end."""
    base, (stream, source) = table_path(spark, "stream"), _in_thirds(spark, d)
    keep = lambda df, batch_id: df.write.mode("append").parquet(f"{base}/out")
    detect.minute_counts(stream).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    remove(spark, source, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS k, max(ts) OVER (PARTITION BY event_type) AS newest FROM events),
 m AS (SELECT event_type, date_trunc('minute', ts) AS minute, newest, count(*) AS n FROM e GROUP BY ALL HAVING date_trunc('minute', ts) + INTERVAL 1 HOUR >= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))
 SELECT event_type, count(*) AS total_requests, count(*) FILTER (value > 1) AS errors, 0::BIGINT AS active, round(avg(value) FILTER (k <= 1000), 6) AS avg_duration,
  coalesce((SELECT n FROM m WHERE m.event_type = e.event_type AND minute = date_trunc('minute', newest)), 0) AS requests_per_minute,
  (SELECT count(*) FROM m WHERE m.event_type = e.event_type AND epoch_us(newest) - epoch_us(minute) <= 3600000000) AS live_minutes,
  coalesce((SELECT sum(n)::BIGINT FROM m WHERE m.event_type = e.event_type AND epoch_us(newest) - epoch_us(minute) <= 3600000000), 0) AS live_requests FROM e GROUP BY event_type""")
def stream_state(spark, d):
    """The state of each kind of event after three micro-batches; minutes have left it that are older than an hour by the kind's own latest request, or by the watermark."""
    base, (stream, source) = table_path(spark, "stream"), _in_thirds(spark, d)
    requests = stream.select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("duration"), F.when(F.col("value") > 1, 500).otherwise(200).alias("status"), F.lit(-1).alias("change"))
    keep = lambda df, batch_id: df.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/out")
    detect.server_state(requests, "event_type", slice_seconds=6 * 3600).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    remove(spark, source, f"{base}/checkpoint")
    last = spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.max_by(F.struct("total_requests", "errors", "active", "avg_duration", "requests_per_minute", "minutes"), "batch").alias("s"))
    return last.select(
        "event_type", "s.total_requests", "s.errors", "s.active", F.round("s.avg_duration", 6).alias("avg_duration"), "s.requests_per_minute",
        F.size("s.minutes").cast("long").alias("live_minutes"), F.aggregate(F.map_values("s.minutes"), F.lit(0).cast("long"), lambda a, n: a + n).alias("live_requests"),
    )


_GAUGE_SQL = """(SELECT max_by(g, (ts, event_id)) - least(0, min(g)) FROM (SELECT ts, event_id, sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS g FROM events))"""


def _shots(spark, d, sink, at):
    """Snapshots of events from three micro-batches in the order of time."""
    stream, source = _in_thirds(spark, d)
    change = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    detect.snapshots(stream, "value", F.col("event_type") == "error", ["ts", "event_id"], sink, at, change=change).awaitTermination()
    remove(spark, source, at)


@query(f"SELECT s.*, {_GAUGE_SQL} AS active FROM ({_SNAPSHOT}) s")
def stream_snapshot(spark, d):
    """The last of three snapshots, with the gauge."""
    base = table_path(spark, "stream")
    _shots(spark, d, f"{base}/out", f"{base}/checkpoint")
    return detect.latest_snapshot(spark, f"{base}/out").select("total_requests", "errors", F.round("avg_duration", 6).alias("avg_duration"), "requests_per_minute", "active")


@query(f"""SELECT 'Server metrics - Requests: ' || total_requests || ' | Active: ' || {_GAUGE_SQL} || ' | Avg Response: ' || printf('%.4f', avg_duration) || 's | Rate: ' || requests_per_minute || '/min | Errors: ' || errors AS message,
 true AS sampled, true AS several FROM ({_SNAPSHOT})""")
def stream_monitor(spark, d):
    """What the monitor logs of the state while it runs; its resources and times differ from run to run, so only whether they are there."""
    base = table_path(spark, "stream")
    _shots(spark, d, f"{base}/out", f"{base}/checkpoint")
    taken: list[dict[str, float]] = []

    def sample() -> dict[str, float]:
        taken.append(detect.resources(0.05))
        return taken[-1]

    running = detect.monitor(spark, f"{base}/out", f"{base}/log", f"{base}/monitor", period="500 milliseconds", sample=sample)
    try:
        while running.isActive and len(taken) < 3:  # then two are written
            running.awaitTermination(1)
    finally:
        running.stop()
    log = spark.read.parquet(f"{base}/log")
    sampled = (F.col("memory_mb") > 0) & (F.col("cpu_percent") >= 0) & (F.col("uptime") > 0) & (F.get_json_object("status", "$.status") == "running")
    return log.groupBy("message").agg(F.bool_and(sampled).alias("sampled"), (F.count(F.lit(1)) > 1).alias("several"))


#: lineitem in the shape of a flow file: name, Spark expression, SQL expression.
_FLOW = (
    ("Flow ID", "concat(l_orderkey, '-', l_linenumber)", "l_orderkey || '-' || l_linenumber"),
    ("Src IP", "concat('10.0.0.', l_suppkey)", "'10.0.0.' || l_suppkey"),
    ("Dst IP", "'10.0.1.1'", "'10.0.1.1'"),
    ("Src Port", "l_partkey", "l_partkey"),
    ("Dst Port", "80", "80"),
    ("Protocol", "6", "6"),
    ("Timestamp", "CAST(l_shipdate AS string)", "l_shipdate::VARCHAR"),
    ("Flow Duration", "l_extendedprice", "l_extendedprice"),
    ("Flow Bytes/s", "IF(l_tax = 0, double('inf'), l_extendedprice / nullif(l_tax, 0))", "CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE l_extendedprice / l_tax END"),
    ("Fwd IAT Total", "l_extendedprice", "l_extendedprice"),
    ("Fwd IAT Mean", "l_quantity", "l_quantity"),
    ("Bwd IAT Mean", "l_discount", "l_discount"),
    ("Fwd Packet Length Mean", "l_quantity * 2", "l_quantity * 2"),
    ("Bwd Packet Length Mean", "l_quantity * 2 + l_tax", "l_quantity * 2 + l_tax"),
    ("Packet Length Std", "l_tax", "l_tax"),
    ("Packet Length Mean", "IF(l_linenumber = 3, 0D, l_quantity)", "CASE WHEN l_linenumber = 3 THEN 0::DOUBLE ELSE l_quantity END"),
    ("Bwd PSH Flags", "0", "0"),
    ("Fwd URG Flags", "0", "0"),
    ("FIN Flag Count", "l_linenumber % 2", "l_linenumber % 2"),
    ("SYN Flag Count", "IF(l_linenumber = 5, 0, l_linenumber % 3)", "CASE WHEN l_linenumber = 5 THEN 0 ELSE l_linenumber % 3 END"),
    ("RST Flag Count", "0", "0"),
    ("ACK Flag Count", "l_linenumber - 1", "l_linenumber - 1"),
    ("Fwd Segment Size Avg", "l_quantity", "l_quantity"),
    ("Bwd Segment Size Avg", "l_quantity", "l_quantity"),
    ("Label", "CASE l_returnflag WHEN 'A' THEN 'BENIGN' WHEN 'N' THEN 'DoS Hulk' WHEN 'R' THEN IF(l_linestatus = 'F' AND l_discount > 0.05, 'DoS slowloris', 'PortScan') END", "CASE l_returnflag WHEN 'A' THEN 'BENIGN' WHEN 'N' THEN 'DoS Hulk' WHEN 'R' THEN CASE WHEN l_linestatus = 'F' AND l_discount > 0.05 THEN 'DoS slowloris' ELSE 'PortScan' END END"),
)
_FLOW_SQL = "(SELECT " + ", ".join(f'{sql} AS "{name}"' for name, _, sql in _FLOW) + " FROM lineitem)"
_CLEAN_SQL = f"""(SELECT DISTINCT * FROM {_FLOW_SQL} WHERE NOT isinf("Flow Bytes/s") AND "Label" IN ('BENIGN', 'DoS Hulk', 'DoS GoldenEye', 'DoS slowloris'))"""


def flow_table(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select(*[F.expr(e).alias(name) for name, e, _ in _FLOW])


#: Rows of a flow file, which one task writes.
FILE_ROWS = 1_000_000


def _flow_files(spark, d) -> tuple[str, int]:
    """lineitem as flow files whose columns lie in different orders, with a column more in some, and how many files a sixth of it has; rows that are equal lie in one file."""
    path, rows = table_path(spark, "landing"), flow_table(spark, d)
    files = max(1, -(-rows.count() // (6 * FILE_ROWS)))
    rows = rows.withColumn("Label", F.when(F.col("`Flow Duration`") % 7 < 1, None).otherwise(F.col("Label")))
    names, side = rows.columns, F.pmod(F.xxhash64("Flow ID"), F.lit(3))
    for i, order in enumerate((names, ["Label", *names[:-1]], [*reversed(names), "Comment"])):
        own = rows.where(side == i).withColumn("Comment", F.lit("none")).repartition(2 * files, "Flow ID")
        own.select(*[f"`{c}`" for c in order]).write.option("header", True).csv(f"{path}/{i}")
    return path, files


_LABELLED = """(SELECT *, CASE WHEN "Flow Duration" % 7 < 1 THEN NULL ELSE "Label" END AS seen FROM """


@query(f"""SELECT label, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN "ACK Flag Count" > 3 THEN 'DoS Hulk' ELSE 'BENIGN' END AS label, 1 AS n
 FROM (SELECT DISTINCT * FROM {_LABELLED} {"{}"}) WHERE NOT isinf("Flow Bytes/s") AND seen IS NOT NULL) UNION ALL SELECT unnest(['BENIGN', 'DoS Hulk', 'DoS GoldenEye', 'DoS slowloris']), 0) GROUP BY label""".replace("{}", _FLOW_SQL))
def stream_flow_files(spark, d):
    """Detection over a landing folder of CSV files, each read by its own header; a rule stands for the model so that counts are known."""
    (landing, files), base = _flow_files(spark, d), table_path(spark, "stream")
    rule = lambda df: df.withColumn("label_predicted", F.when(F.col("`ACK Flag Count`") > 3, "DoS Hulk").otherwise("BENIGN"))
    detect.detect_files(S.stream_files(spark, f"{landing}/*", files), flow_table(spark, d).schema, rule, clean.LABELS, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    remove(spark, landing, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("label").agg(F.sum("n").alias("n"))


@query(f"""SELECT "Label" AS label, count(*) AS n, round(sum("Fwd IAT Mean"), 2) AS iat, count(*) FILTER (isinf("Flow Bytes/s")) AS infinite, sum("ACK Flag Count")::BIGINT AS acks FROM {_FLOW_SQL} GROUP BY ALL""")
def csv_flows(spark, d):
    """A flow CSV file, its types found from its rows."""
    path = table_path(spark, "csv")
    flow_table(spark, d).write.option("header", True).csv(path)
    rows = S.read_flows(spark, path).groupBy(F.col("Label").alias("label"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Fwd IAT Mean"), 2).alias("iat"), F.count_if(F.abs("Flow Bytes/s") == float("inf")).alias("infinite"), F.sum("ACK Flag Count").alias("acks"))


@query("SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def log_files(spark, d):
    """Log files as text, read back by their lines."""
    path, rows = table_path(spark, "log"), _t(spark, d, "events")
    rows.select(S.log_line(F.col("ts"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.concat(F.lit("took "), "value"))).write.text(path)
    return S.read_log(spark, path).where("level IS NOT NULL").groupBy("level", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT "Label" AS label, "Flow Duration" AS duration, "Flow Bytes/s" AS rate, "ACK Flag Count" AS acks FROM {_CLEAN_SQL}""")
def flow_clean(spark, d):
    rows = clean.clean_flows(flow_table(spark, d))
    assert not set(clean.REMOVE) & set(rows.columns)
    return rows.select(F.col("Label").alias("label"), F.col("Flow Duration").alias("duration"), F.col("Flow Bytes/s").alias("rate"), F.col("ACK Flag Count").alias("acks"))


_ENGINEER_SQL = f"""(SELECT "Flow Duration", "Flow Bytes/s", "Fwd IAT Mean", "Bwd IAT Mean", "Fwd Packet Length Mean", "Bwd Packet Length Mean", "Packet Length Std", "Packet Length Mean", "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "ACK Flag Count",
 "Fwd IAT Mean" / CASE WHEN "Bwd IAT Mean" = 0 THEN 0.1 ELSE "Bwd IAT Mean" END AS "IAT_ratio", "Fwd Packet Length Mean" / CASE WHEN "Bwd Packet Length Mean" = 0 THEN 0.1 ELSE "Bwd Packet Length Mean" END AS "Packet_Length_Ratio",
 "Packet Length Std" / CASE WHEN "Packet Length Mean" = 0 THEN 0.1 ELSE "Packet Length Mean" END AS "Packet_Size_CV", ("FIN Flag Count" + "SYN Flag Count" + "RST Flag Count" + "ACK Flag Count")::DOUBLE AS "Total_Flags",
 ("FIN Flag Count" > 0)::INT + ("SYN Flag Count" > 0)::INT + ("RST Flag Count" > 0)::INT + ("ACK Flag Count" > 0)::INT AS "Flag_Diversity",
 ("FIN Flag Count" + "SYN Flag Count" + "RST Flag Count")::DOUBLE / CASE WHEN "FIN Flag Count" + "SYN Flag Count" + "RST Flag Count" + "ACK Flag Count" = 0 THEN 1 ELSE "FIN Flag Count" + "SYN Flag Count" + "RST Flag Count" + "ACK Flag Count" END AS "Control_Flag_Ratio" FROM {_CLEAN_SQL})"""
_DERIVED = ["IAT_ratio", "Packet_Length_Ratio", "Packet_Size_CV", "Total_Flags", "Flag_Diversity", "Control_Flag_Ratio"]


def _engineered(spark, d) -> DataFrame:
    return X.engineer(clean.clean_flows(flow_table(spark, d)).drop("Label"))


@query(f"SELECT {', '.join(f'round({c}, 8) AS {c}' if c != 'Flag_Diversity' else c for c in _DERIVED)} FROM {_ENGINEER_SQL}")
def flow_engineer(spark, d):
    return _engineered(spark, d).select(*[F.round(c, 8).alias(c) if c != "Flag_Diversity" else F.col(c) for c in _DERIVED])


_FLOW_COLS = ["Flow Duration", "Flow Bytes/s", "Fwd IAT Mean", "Bwd IAT Mean", "Fwd Packet Length Mean", "Bwd Packet Length Mean", "Packet Length Std", "Packet Length Mean", "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "ACK Flag Count", *_DERIVED]
_FLOW_PAIRS = " UNION ALL ".join(f"""SELECT '{b}' AS a, corr("{b}", "{a}") AS r, var_samp("{a}") > 0 AND var_samp("{b}") > 0 AS ok FROM e""" for i, b in enumerate(_FLOW_COLS) for a in _FLOW_COLS[:i])
_FLOW_VARS = " UNION ALL ".join(f"""SELECT '{c}' AS feature, var_samp("{c}") AS v FROM e""" for c in _FLOW_COLS)


@query(f"WITH e AS MATERIALIZED (SELECT * FROM {_ENGINEER_SQL}) SELECT feature FROM ({_FLOW_VARS}) WHERE NOT v < 0.01 AND feature NOT IN (SELECT a FROM ({_FLOW_PAIRS}) WHERE ok AND r > 0.95)")
def flow_select(spark, d):
    """The features that variance and correlation leave, of a flow file with all derived ones."""
    return spark.createDataFrame([(c,) for c in analyze.kept_features(_engineered(spark, d).select(*[f"`{c}`" for c in _FLOW_COLS]), _FLOW_COLS)], "feature string")


def _part_sql(side: str) -> str:
    """The CTEs' sources over the lines of one side of the split of files for training and testing."""
    return _ENGINEER_SQL.replace("FROM lineitem)", f"FROM lineitem WHERE l_partkey % 5 {side} 0)")


@query(f"""WITH e AS MATERIALIZED (SELECT * FROM {_part_sql("<>")}), k AS (SELECT a FROM ({_FLOW_PAIRS}) WHERE ok AND r > 0.95)
 SELECT 'missing' AS kind, 'Flow Bytes/s' AS name, count(*) AS n FROM lineitem WHERE l_partkey % 5 <> 0 AND l_tax = 0
 UNION ALL SELECT 'flat', feature, 0 FROM ({_FLOW_VARS}) WHERE v < 0.01 UNION ALL SELECT DISTINCT 'dropped', a, 0 FROM k UNION ALL SELECT 'tested', 'rows', count(*) FROM {_part_sql("=")}""")
def flow_train(spark, d):
    """A training run from flow tables to a saved and evaluated model: what doesn't hang on random draws of it. Forests of 5 trees of depth 5."""
    rows, path = flow_table(spark, d), table_path(spark, "model")
    own = F.col("`Src Port`") % 5
    run = programs.train(rows.where(own != 0), rows.where(own == 0), path, trees=5, depth=5)
    remove(spark, path)
    small_parts = [("flat", c, 0) for c in run.low_variance] + [("dropped", c, 0) for c in run.dropped]
    found = run.missing.select(F.lit("missing").alias("kind"), F.col("column").alias("name"), F.col("n_null").alias("n"))
    tested = run.report.where("class = 'accuracy'").select(F.lit("tested").alias("kind"), F.lit("rows").alias("name"), F.col("support").alias("n"))
    return found.unionAll(spark.createDataFrame(small_parts, "kind string, name string, n long")).unionAll(tested)


_LONG = " UNION ALL ".join(f"SELECT {i} AS place, {c}::FLOAT::DOUBLE AS x, l_returnflag AS y FROM lineitem" for i, c in enumerate(NUM))


@query(f"""WITH v AS (SELECT place, x, count(*) FILTER (y = 'A')::DOUBLE a, count(*) FILTER (y = 'N')::DOUBLE b, count(*) FILTER (y = 'R')::DOUBLE c FROM ({_LONG}) GROUP BY ALL),
 w AS (SELECT place, x, lead(x) OVER o AS z, sum(a) OVER (o ROWS UNBOUNDED PRECEDING) la, sum(b) OVER (o ROWS UNBOUNDED PRECEDING) lb, sum(c) OVER (o ROWS UNBOUNDED PRECEDING) lc, sum(a) OVER p ta, sum(b) OVER p tb, sum(c) OVER p tc FROM v WINDOW o AS (PARTITION BY place ORDER BY x), p AS (PARTITION BY place)),
 s AS (SELECT *, la + lb + lc AS nl, ta + tb + tc AS n, ta + tb + tc - (la + lb + lc) AS nr FROM w WHERE z - x > 1e-7),
 k AS (SELECT * FROM s ORDER BY (la*la + lb*lb + lc*lc) / nl + ((ta-la)*(ta-la) + (tb-lb)*(tb-lb) + (tc-lc)*(tc-lc)) / nr DESC, place, x LIMIT 1)
 SELECT 0 AS node_id, place AS feature, round(x / 2 + z / 2, 6) AS threshold, n::BIGINT AS n_node_samples, round(1 - (ta*ta + tb*tb + tc*tc) / (n * n), 8) AS impurity, round(ta / n, 8) AS p0 FROM k
 UNION ALL SELECT 1, -2, -2.0, nl::BIGINT, round(1 - (la*la + lb*lb + lc*lc) / (nl * nl), 8), round(la / nl, 8) FROM k
 UNION ALL SELECT 2, -2, -2.0, nr::BIGINT, round(1 - ((ta-la)*(ta-la) + (tb-lb)*(tb-lb) + (tc-lc)*(tc-lc)) / (nr * nr), 8), round((ta - la) / nr, 8) FROM k""")
def tree_fit(spark, d):
    """An exact tree of depth 1; deeper ones and all stopping rules are tested against brute force."""
    nodes = tree.Tree(max_depth=1).fit(_t(spark, d, "lineitem"), NUM, "l_returnflag")
    return nodes.select("node_id", "feature", F.round("threshold", 6).alias("threshold"), "n_node_samples", F.round("impurity", 8).alias("impurity"), F.round(F.get("value", F.lit(0)), 8).alias("p0"))


def _stumps_sql(rows: str, classes: list[str], where: str = "true") -> str:
    """Trees of depth 1 from (tree_id, place, x, y, w): rows counted, classes weighed, the best threshold that `where` allows."""
    k = range(len(classes))
    total = lambda p: " + ".join(f"{p}{i}" for i in k)
    squares = lambda p: " + ".join(f"{p}{i} * {p}{i}" for i in k)
    share = lambda p, n: f"round(1 - ({squares(p)}) / ({n} * {n}), 8) AS impurity, round({p}0 / {n}, 8) AS p0"
    return f"""WITH v AS (SELECT tree_id, place, x, count(*) AS c, {", ".join(f"coalesce(sum(w) FILTER (y = '{y}'), 0)::DOUBLE AS c{i}" for i, y in enumerate(classes))} FROM ({rows}) WHERE w <> 0 GROUP BY ALL),
 w AS (SELECT *, lead(x) OVER o AS z, sum(c) OVER (o ROWS UNBOUNDED PRECEDING) AS cl, sum(c) OVER p AS ct, {", ".join(f"sum(c{i}) OVER (o ROWS UNBOUNDED PRECEDING) AS l{i}, sum(c{i}) OVER p AS t{i}" for i in k)} FROM v WINDOW o AS (PARTITION BY tree_id, place ORDER BY x), p AS (PARTITION BY tree_id, place)),
 r AS (SELECT *, {", ".join(f"t{i} - l{i} AS r{i}" for i in k)}, {total("l")} AS nl, {total("t")} AS n, ct - cl AS cr FROM w WHERE z - x > 1e-7),
 s AS (SELECT *, n - nl AS nr FROM r),
 k AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY ({squares("l")}) / nl + ({squares("r")}) / nr DESC, place, x) AS best FROM s WHERE {where})
 SELECT tree_id, 0 AS node_id, place AS feature, round(x / 2 + z / 2, 6) AS threshold, ct::BIGINT AS n_node_samples, n AS weighted_n, {share("t", "n")} FROM k WHERE best = 1
 UNION ALL SELECT tree_id, 1, -2, -2.0, cl::BIGINT, nl, {share("l", "nl")} FROM k WHERE best = 1
 UNION ALL SELECT tree_id, 2, -2, -2.0, cr::BIGINT, nr, {share("r", "nr")} FROM k WHERE best = 1"""


def _stumps(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree_id", "node_id", "feature", F.round("threshold", 6).alias("threshold"), "n_node_samples", "weighted_n", F.round("impurity", 8).alias("impurity"), F.round(F.get("value", F.lit(0)), 8).alias("p0"))


_WEIGHED = " UNION ALL ".join(f"SELECT 0 AS tree_id, {i} AS place, {c}::FLOAT::DOUBLE AS x, l_returnflag AS y, (l_linenumber - 1) AS w FROM lineitem" for i, c in enumerate(NUM))


@query(_stumps_sql(_WEIGHED, CLASSES, "cl >= 100 AND cr >= 100 AND nl >= 0.45 * n AND nr >= 0.45 * n"))
def weighted_tree(spark, d):
    """An exact tree of depth 1 over weighted rows, those of weight 0 left out, with bounds on the rows and the weight of a leaf."""
    rows = _t(spark, d, "lineitem").withColumn("weight", F.col("l_linenumber") - 1)
    return _stumps(tree.Tree(max_depth=1, min_samples_leaf=100, min_weight_fraction_leaf=0.45).fit(rows, NUM, "l_returnflag", "weight"))


_BAGGED = " UNION ALL ".join(f"SELECT tree_id, {i} AS place, {c}::FLOAT::DOUBLE AS x, o_orderstatus AS y, times AS w FROM bag JOIN orders USING (o_orderkey)" for i, c in enumerate(("o_custkey", "o_totalprice")))


@query(f"WITH bag AS MATERIALIZED ({_draws_sql(3, '(SELECT count(*) FROM orders)')}) {_stumps_sql(_BAGGED, ['F', 'O', 'P']).replace('WITH v AS', ', v AS', 1)}")
def exact_forest(spark, d):
    """Three exact trees of depth 1, each over its own sample of orders with replacement."""
    params = forest.ForestParams(n_estimators=3, max_depth=1, max_features=None)
    nodes, _, _ = forest.fit_exact_forest(_t(spark, d, "orders"), ["o_custkey", "o_totalprice"], "o_orderstatus", params, ["o_orderkey"])
    return _stumps(nodes)


@query(_TREES + " SELECT tree_id, count(*) AS nodes, count(*) FILTER (l < 0) AS leaves, round(sum(decrease), 4) AS decrease FROM n GROUP BY tree_id")
def saved_nodes(spark, d):
    """A node table written and read back with its schema checked."""
    path = table_path(spark, "nodes")
    S.save_nodes(_grown(spark, d), path)
    nodes = cut(S.load_nodes(spark, path))
    remove(spark, path)
    return nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("left") < 0).alias("leaves"), F.round(F.sum("decrease"), 4).alias("decrease"))


@query(_IMPORTANCE + "SELECT x.name AS feature_name, round(coalesce(importance, 0), 8) AS importance FROM (VALUES (0, 'l_quantity'), (1, 'l_extendedprice'), (2, 'l_discount'), (3, 'l_tax')) x(feature, name) LEFT JOIN f USING (feature)")
def named_importance(spark, d):
    return forest.named_importance(forest.forest_importance(_grown(spark, d)), NUM).withColumn("importance", F.round("importance", 8))
