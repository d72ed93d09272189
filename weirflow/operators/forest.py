"""Random forests: MLlib or exact training, node tables, scoring and importances."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.flows import save_nodes
from ..storage import cut, remove, small, table_path
from .compiled import BROADCAST_NODES, Compiled, compiled, matrix  # noqa: F401
from .prefix import ranked

MLLIB_DEPTH = 30
#: MLlib keeps its rows in memory or on disk, and every level reads a part whole: about so many bytes of them make a part.
PART_BYTES = 128 << 20


def label_index(df: DataFrame, label: str) -> DataFrame:
    """(label, code): codes in the order of the labels. The labels are few: one row each."""
    return df.select(label).distinct().select(label, (F.dense_rank().over(W.orderBy(label)) - 1).alias("code"))


def samples_drawn(n_rows: int, max_samples: int | float | None) -> int:
    """Rows drawn for a tree: all, so many (not above n_rows), or a rounded share, 1 at least."""
    if max_samples is None:
        return n_rows
    if isinstance(max_samples, int):
        if max_samples > n_rows:
            raise ValueError(f"max_samples={max_samples} is above the number of rows, {n_rows}")
        return max_samples
    return max(round(n_rows * max_samples), 1)


def drawn_rows(slots: DataFrame, tree: str, slot: str, n_rows: int, seed: int, name: str = "_row") -> DataFrame:
    """slots with the number of the row that each slot of a tree's sample draws: two xorshift steps over a mixed counter.

    Every shift is a projection of its own, which Spark doesn't inline: as one expression the steps
    would repeat each other so often that no code is generated for them.
    """
    long, s = lambda v: F.lit(v).cast("long"), F.col(name)
    mask = long(0xFFFFFFFF)
    out = slots.withColumn(name, (F.col(slot).cast("long") * long(40503) + F.col(tree).cast("long") * long(69069) + long(seed)).bitwiseAND(mask))
    for last in (False, True):
        out = out.withColumn(name, F.when(s == 0, long(1)).otherwise(s.bitwiseAND(mask)))
        out = out.withColumn(name, s.bitwiseXOR(F.shiftleft(s, 13)).bitwiseAND(mask))
        out = out.withColumn(name, s.bitwiseXOR(F.shiftright(s, 17)))
        out = out.withColumn(name, s.bitwiseXOR(F.shiftleft(s, 5)).bitwiseAND(mask) % long(1 << 31))
        out = out.withColumn(name, s % long(n_rows) if last else s * long(2) + long(1))
    # never null, as Spark knows by this: no join needs to filter it below these steps
    return out.withColumn(name, F.coalesce(s, long(0)))


def bootstrap(df: DataFrame, order: Sequence[str], *, trees: int = 1, seed: int = 42, max_samples: int | float | None = None, n_rows: int | None = None) -> DataFrame:
    """df's rows with tree_id and `times`, how often each tree's sample with replacement holds the row (rows it doesn't hold are left out).

    Rows are numbered densely in `order` (which should identify them) without a global window; the
    draws are counted before they are joined, so a tree costs one row for each distinct draw.
    """
    numbered = ranked(df.withColumn("_all", F.lit(1)), ["_all"], order, "_row").withColumn("_row", F.col("_row") - 1).drop("_all")
    n = df.count() if n_rows is None else n_rows
    if not n:
        return numbered.drop("_row").select(F.lit(0).alias("tree_id"), "*", F.lit(0).cast("long").alias("times"))
    slots = df.sparkSession.range(samples_drawn(n, max_samples)).select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree_id"), F.col("id").alias("_slot"))
    draws = drawn_rows(slots, "tree_id", "_slot", n, seed).groupBy("tree_id", "_row").agg(F.count(F.lit(1)).alias("times"))
    return numbered.join(draws, "_row").select("tree_id", *df.columns, "times")


def max_features(rule: str | int | float | None, n: int) -> int:
    """Features tried at a split: sqrt and log2 are cut, not rounded; a share is of all; 1 at least."""
    if rule is None:
        return n
    if rule == "sqrt":
        return max(1, int(math.sqrt(n)))
    if rule == "log2":
        return max(1, int(math.log2(n)))
    if isinstance(rule, str):
        raise ValueError(f"max_features: {rule!r}")
    return max(1, int(rule * n)) if isinstance(rule, float) else int(rule)


def class_weights(df: DataFrame, label: str, rule: str | dict[str, float] | None) -> dict[str, float]:
    """Weight of each label: given, or "balanced": all labels weigh the same together."""
    if rule is None or isinstance(rule, dict):
        return rule or {}
    if rule != "balanced":
        raise ValueError(f"class_weight: {rule!r}")
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}  # one row for each label
    return {c: sum(counts.values()) / (len(counts) * n) for c, n in counts.items()}


@dataclass(frozen=True)
class ForestParams:
    """Parameters of a forest, by the names that its users know.

    n_jobs and verbose have no effect: Spark schedules, and the library prints nothing. Only "gini"
    grows trees exactly; MLlib takes "entropy" too. Pruning (ccp_alpha) and max_leaf_nodes aren't
    offered and raise. oob_score is an accuracy that fit_exact_forest reports.
    """

    n_estimators: int = 100
    criterion: str = "gini"
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    min_weight_fraction_leaf: float = 0.0
    max_features: str | int | float | None = "sqrt"
    max_leaf_nodes: int | None = None
    min_impurity_decrease: float = 0.0
    bootstrap: bool = True
    oob_score: bool = False
    n_jobs: int | None = None
    random_state: int = 42
    verbose: int = 0
    class_weight: str | dict[str, float] | None = None
    ccp_alpha: float = 0.0
    max_samples: int | float | None = None

    def checked(self, exact: bool) -> ForestParams:
        if self.n_estimators <= 0:
            raise ValueError("n_estimators must be positive")
        if not self.bootstrap and self.max_samples is not None:
            raise ValueError("max_samples needs bootstrap")
        if not self.bootstrap and self.oob_score:
            raise ValueError("oob_score needs bootstrap")
        if self.max_leaf_nodes is not None or self.ccp_alpha:
            raise ValueError("max_leaf_nodes and ccp_alpha aren't offered")
        if self.criterion not in (("gini",) if exact else ("gini", "entropy")):
            raise ValueError(f"criterion: {self.criterion!r}")
        if not exact and (self.max_depth or 0) > MLLIB_DEPTH:
            raise ValueError(f"MLlib's trees have a depth of {MLLIB_DEPTH} at most")
        if not exact and (self.min_samples_split > max(2, 2 * self.min_samples_leaf) or self.oob_score):
            raise ValueError("min_samples_split and oob_score need an exact forest")
        return self


def parts_for(n_rows: int, features: int, trees: int) -> int:
    """Parts of a training table, so that none grows with it. A row of MLlib's takes some 300 bytes, 4 a feature and 12 a tree (measured)."""
    return max(1, math.ceil(n_rows * (300 + 4 * features + 12 * trees) / PART_BYTES))


def fit_forest(df: DataFrame, features: Sequence[str], label: str, *, n_estimators: int = 100, max_depth: int | None = 20, seed: int = 42, weight: str | None = None, written: bool = False, **params) -> tuple[RandomForestClassificationModel, list[str]]:
    """MLlib forest over float32 features; returns it with the labels in the order of its codes. max_depth None: MLlib's most, 30.

    written: df reads a written table, whose rows come in the same order each time; else what the
    forest needs of it is cut first.
    """
    p = ForestParams(n_estimators=n_estimators, max_depth=max_depth, random_state=seed, **params).checked(exact=False)
    if not written:
        df = cut(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*features, label, *([weight] if weight else [])])]))
    sizes = df.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each label
    classes = sorted((r.label for r in sizes), key=lambda c: (c is not None, c))
    # few labels: a literal map instead of a join
    code = F.array_position(F.array(*map(F.lit, classes)), F.col(f"`{label}`")) - 1
    by_class = class_weights(df, label, p.class_weight)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if by_class:
        w = w * F.coalesce(F.element_at(F.create_map(*[x for c, v in by_class.items() for x in (F.lit(c), F.lit(float(v)))]), F.col(f"`{label}`")), F.lit(1.0))
    rows = df.select(*[F.col(f"`{c}`").cast("float").cast("double").alias(c) for c in features], code.cast("double").alias("_y"), w.alias("_w"))
    parts = parts_for(sum(r.n for r in sizes), len(features), p.n_estimators)
    if parts > 1:  # dealt by their places in the written table: evenly, however many are equal, and again the same if a task is repeated
        rows = rows.repartition(parts, F.monotonically_increasing_id())
    assembled = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows).select("_x", "_y", "_w")
    share = 1.0
    if p.max_samples is not None:
        n = sum(r.n for r in sizes)
        share = samples_drawn(n, p.max_samples) / max(n, 1)
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=p.n_estimators, impurity=p.criterion, maxDepth=MLLIB_DEPTH if p.max_depth is None else p.max_depth,
        minInstancesPerNode=p.min_samples_leaf, minWeightFractionPerNode=p.min_weight_fraction_leaf, minInfoGain=p.min_impurity_decrease,
        featureSubsetStrategy=str(max_features(p.max_features, len(features))), bootstrap=p.bootstrap, subsamplingRate=share, seed=p.random_state, maxBins=64, cacheNodeIds=True,
    )
    return forest.fit(assembled), classes


def fit_exact_forest(df: DataFrame, features: Sequence[str], label: str, params: ForestParams, order: Sequence[str], weight: str | None = None) -> tuple[DataFrame, list[str], float | None]:
    """(node table, labels, out-of-bag accuracy if asked for): trees of exact splits over samples with replacement.

    All trees grow together: a pass over the rows, which are written once, for each level. Each row
    carries the trees whose samples hold it and how often, and a tree weighs it so; `order` should
    identify the rows, which are drawn by their rank in it.
    """
    from .grow import flat, grow
    from .grow import node_table as grown
    from .tree import Tree, checked_rows

    p = params.checked(exact=True)
    by_class = class_weights(df, label, p.class_weight)
    kept = cut(checked_rows(df, features, label, weight, *order))
    if by_class:
        kept = kept.withColumn("w", F.col("w") * F.coalesce(F.element_at(F.create_map(*[x for c, v in by_class.items() for x in (F.lit(c), F.lit(float(v)))]), F.col("_label")), F.lit(1.0)))
    numbered = ranked(kept.withColumn("_all", F.lit(1)), ["_all"], order, "_row").withColumn("_row", F.col("_row") - 1)
    n = kept.count()
    every = F.array(*map(F.lit, range(p.n_estimators)))
    if p.bootstrap and n:
        slots = df.sparkSession.range(samples_drawn(n, p.max_samples)).select(F.explode(every.cast("array<int>")).alias("tree"), F.col("id").alias("_slot"))
        draws = drawn_rows(slots, "tree", "_slot", n, p.random_state).groupBy("_row", "tree").agg(F.count(F.lit(1)).cast("int").alias("times"))
        bags = draws.groupBy("_row").agg(F.collect_list(F.struct("tree", "times")).alias("bag"))  # an entry for each tree
        rows = numbered.join(bags, "_row", "left").withColumns({"trees": F.coalesce("bag.tree", F.array().cast("array<int>")), "times": F.coalesce("bag.times", F.array().cast("array<int>"))})
    else:
        rows = numbered.withColumns({"trees": every.cast("array<int>"), "times": F.array_repeat(F.lit(1), p.n_estimators)})
    classes = [r[0] for r in label_index(kept, "_label").orderBy("code").collect()]
    code = F.array_position(F.array(*map(F.lit, classes)), F.col("_label")).cast("int") - 1 if classes else F.lit(0)
    rows = cut(rows.select("_row", *flat(len(features)), code.alias("y"), "w", "trees", "times"))
    tree = Tree(p.max_depth, p.min_samples_split, p.min_samples_leaf, p.min_weight_fraction_leaf, p.max_features, p.min_impurity_decrease, p.random_state)
    table = cut(grown(df, grow(rows, len(features), max(1, len(classes)), tree.rules(len(features), p.n_estimators)), features))
    return table, classes, _out_of_bag(rows, table) if p.oob_score and n else None


def _out_of_bag(rows: DataFrame, nodes: DataFrame) -> float | None:
    """The share of rows whose class most of the trees say whose samples don't hold them; rows that all hold are left out."""
    said = None
    for model in compiled(nodes):

        def run(batches: Iterator[pa.RecordBatch], model: Compiled = model) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                out = np.ones((b.num_rows, int(model.trees.max()) + 1 if len(model.trees) else 0), bool)
                row = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
                tree = b.column(2).flatten().to_numpy()
                inside = tree < out.shape[1]
                out[row[inside], tree[inside]] = False
                at = model.leaves(x)
                shares = sum((model.values[at[:, k]] * out[:, t, None] for k, t in enumerate(model.trees)), np.zeros((b.num_rows, model.values.shape[1])))
                yield pa.RecordBatch.from_arrays([b.column(3), b.column(1), pa.array(list(shares), pa.list_(pa.float64()))], ["id", "y", "shares"])

        # the sums of groups of trees meet by the row
        x = F.array(*[c for c in rows.columns if c[0] == "x"])
        part = rows.select(x.alias("x"), "y", "trees", F.col("_row").cast("long").alias("id")).mapInArrow(run, "id long, y int, shares array<double>")
        said = part if said is None else said.unionAll(part)
    if said is None:
        return None
    if len(list(compiled(nodes))) > 1:
        width = len(said.first().shares)
        said = said.groupBy("id", "y").agg(F.array(*[F.sum(F.get("shares", F.lit(i))) for i in range(width)]).alias("shares"))
    right = (F.array_position("shares", F.array_max("shares")) - 1 == F.col("y")).cast("double")
    return said.where(F.array_max("shares") > 0).agg(F.avg(right)).first()[0]


def score(model: RandomForestClassificationModel, df: DataFrame, features: Sequence[str], classes: Sequence[str], proba: bool = False) -> DataFrame:
    """df with label_predicted, and with proba an array `probability` in the order of classes; features are taken by name."""
    names = [f"_x{i}" for i in range(len(features))]
    rows = df.withColumns({n: F.col(f"`{c}`").cast("float").cast("double") for n, c in zip(names, features, strict=True)})
    scored = model.transform(VectorAssembler(inputCols=names, outputCol="_x").transform(rows))
    named = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("prediction").cast("int") + 1)
    out = scored.withColumn("label_predicted", named)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "label_predicted", *([vector_to_array("probability").alias("probability")] if proba else []))


def save_forest(spark: SparkSession, path: str, model: RandomForestClassificationModel, features: Sequence[str], classes: Sequence[str], params: ForestParams | None = None) -> None:
    """The model, the names that it needs, and its nodes, in one folder."""
    model.write().overwrite().save(f"{path}/model")
    about = json.dumps({"features": list(features), "classes": list(classes), "params": asdict(params) if params else None})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    save_nodes(node_table(spark, model, f"{path}/model"), f"{path}/nodes")


def load_forest(spark: SparkSession, path: str) -> tuple[RandomForestClassificationModel, list[str], list[str]]:
    """(model, features, classes) of save_forest."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return RandomForestClassificationModel.load(f"{path}/model"), about["features"], about["classes"]


def node_table(spark: SparkSession, model: RandomForestClassificationModel, saved: str | None = None) -> DataFrame:
    """The model's nodes, numbered in pre-order; leaves have -1, -1, -2, -2.0. Read from the model as MLlib saves it."""
    path = saved or table_path(spark, "model")
    if saved is None:
        model.write().overwrite().save(path)
    tree = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    stats, total = F.col("impurityStats"), F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    inner = F.col("leftChild") >= 0
    nodes = tree.select(
        F.col("treeID").cast("int").alias("tree_id"), F.col("id").cast("int").alias("node_id"), F.when(inner, F.col("leftChild")).otherwise(-1).cast("int").alias("left"), F.when(inner, F.col("rightChild")).otherwise(-1).cast("int").alias("right"),
        F.when(inner, F.col("split.featureIndex")).otherwise(-2).cast("int").alias("feature"), F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).otherwise(-2.0).alias("threshold"),
        "impurity", F.col("rawCount").cast("long").alias("n_node_samples"), total.alias("weighted_n"), F.transform(stats, lambda x: F.when(total > 0, x / total).otherwise(0.0)).alias("value"),
        F.when(inner, F.col("gain") * total).otherwise(0.0).alias("decrease"),
    )
    nodes = cut(nodes)
    if saved is None:
        remove(spark, path)
    return nodes


def descend(rows: DataFrame, nodes: DataFrame, key: str, features: Sequence[str], depth: int | None = None) -> DataFrame:
    """(key, tree_id, node_id) of the leaf that each row reaches in each tree: one scan, no join, whatever the depth.

    A model of more than BROADCAST_NODES nodes goes in groups of trees, with a scan for each. A
    depth that is given must not be smaller than the model's.
    """
    kind = rows.schema[key].dataType.simpleString()
    found = None
    for model in compiled(cut(nodes)):
        if depth is not None and depth < model.depth():
            raise ValueError(f"the model has a depth of {model.depth()}, not {depth}")

        def run(batches: Iterator[pa.RecordBatch], model: Compiled = model) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = model.leaves(matrix(b.columns[1:]))
                ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), len(model.trees))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(model.trees, b.num_rows).astype(np.int32)), pa.array(model.node[at.ravel()].astype(np.int32))], [key, "tree_id", "node_id"])

        x = rows.select(key, *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
        own = x.mapInArrow(run, f"`{key}` {kind}, tree_id int, node_id int")
        found = own if found is None else found.unionAll(own)
    return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, tree_id int, node_id int") if found is None else found


def _shares(model: Compiled):
    def summed(*columns: pa.Array) -> pa.Array:
        shares = model.shares(matrix(columns))
        ends = np.arange(len(shares) + 1, dtype=np.int32) * shares.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(shares.ravel()))

    return F.arrow_udf(summed, "array<double>")


def score_nodes(df: DataFrame, nodes: DataFrame, features: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """df with p0, p1, ... (the mean of the trees' class shares) and label_predicted (of the largest, the first of equal ones).

    One scan: each group of trees is an expression over the features' columns; shares are summed in
    the order of the trees, so that equal votes are equal to the last bit.
    """
    models = list(compiled(cut(nodes)))
    if not models:
        raise ValueError("a model without nodes")
    sums = [_shares(model)(*[F.col(f"`{c}`").cast("double") for c in features]) for model in models]
    trees = float(sum(len(m.trees) for m in models))
    rows = df.withColumns({f"_s{k}": s for k, s in enumerate(sums)})
    total = lambda i: reduce(lambda a, b: a + b, [F.get(f"_s{k}", F.lit(i)) for k in range(len(sums))])
    scored = rows.withColumns({f"p{i}": total(i) / trees for i in range(len(classes))})
    shares_ = F.array(*[F.col(f"p{i}") for i in range(len(classes))])
    named = F.element_at(F.array(*map(F.lit, classes)), F.array_position(shares_, F.array_max(shares_)).cast("int"))
    return scored.withColumn("label_predicted", named).drop(*[f"_s{k}" for k in range(len(sums))])


def leaf_values(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """leaves with the class shares of their node; the node table is broadcast if it is small enough."""
    return leaves.join(small(cut(nodes.select("tree_id", "node_id", "value"))), ["tree_id", "node_id"])


def vote(values: DataFrame, key: str, classes: Sequence[str]) -> DataFrame:
    """Mean of the trees' class shares; the label with the largest, the first of equal ones.

    Shares are summed in the order of the trees, so that equal votes are equal to the last bit.
    """
    ordered = values.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("tree_id", "value"))).alias("_v"))
    mean = lambda i: F.aggregate("_v", F.lit(0.0), lambda s, v: s + F.get(v["value"], F.lit(i))) / F.size("_v")
    means = ordered.select(key, *[mean(i).alias(f"p{i}") for i in range(len(classes))])
    shares = F.array(*[F.col(f"p{i}") for i in range(len(classes))])
    named = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(shares, F.array_max(shares)).cast("int"))
    return means.withColumn("label_predicted", named)


def tree_importance(nodes: DataFrame) -> DataFrame:
    """(tree_id, feature, importance): the impurity that a feature's splits take off, as a share of each tree's; the nodes know it, so there is no join."""
    drop = nodes.where("left >= 0").groupBy("tree_id", "feature").agg(F.sum("decrease").alias("raw"))
    total = F.sum("raw").over(W.partitionBy("tree_id"))
    return drop.select("tree_id", "feature", F.when(total > 0, F.col("raw") / total).otherwise(0.0).alias("importance"))


def forest_importance(nodes: DataFrame) -> DataFrame:
    """(feature, importance): mean over trees with more than a root, normalised; no rows if there are none."""
    by_tree = tree_importance(nodes)
    trees = by_tree.select("tree_id").distinct().agg(F.count(F.lit(1)).alias("_n"))
    means = by_tree.groupBy("feature").agg(F.sum("importance").alias("_s")).join(F.broadcast(trees)).select("feature", (F.col("_s") / F.col("_n")).alias("_m"))
    total = means.agg(F.sum("_m").alias("_t"))
    return means.join(F.broadcast(total)).select("feature", F.when(F.col("_t") > 0, F.col("_m") / F.col("_t")).otherwise(0.0).alias("importance"))


def named_importance(importance: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_name, importance) of all features, 0 for one that no split uses; `feature` is its place among features."""
    names = importance.sparkSession.createDataFrame(list(enumerate(features)), "feature int, feature_name string")
    return names.join(importance, "feature", "left").select("feature_name", F.coalesce("importance", F.lit(0.0)).alias("importance"))


