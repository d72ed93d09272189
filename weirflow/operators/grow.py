"""Exact growth of all trees of a forest, level by level.

The rows are written once, each with the trees whose samples hold it. At every level one pass over
them finds the open node of each row in each tree, by the trees' node arrays so far, and counts the
values of the features that the node tries; one aggregate and one scan over ranges of the values
give the best splits of all nodes of all trees. A row isn't written again, so the passes over the
rows grow with the depth, not with the number of trees.

On a large table the rows are first counted by ranges of the values. The borders of ranges are
thresholds themselves, and no threshold inside a range can be better than the best way to deal its
classes to both sides. Only ranges that could still hold the best split of their node are then
counted value by value, so the result is the same and few values are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.flows import NODE_SCHEMA
from ..storage import cut
from .compiled import Compiled
from .prefix import scanned
from .split import GAP, Candidates, best_split, candidates, rated_rows, summed, tallied

#: Below this an impurity counts as zero, and a split may fall short of the decrease asked for (fixed value: the double's epsilon).
EPSILON = 2.220446049250313e-16
#: A model is held on the driver and in every task; one that grows beyond so many nodes is an error.
MODEL_NODES = 2_000_000
#: Rows of a batch that are counted at a time.
ROWS = 1 << 14
#: Ranges of a feature's values, and of all open nodes' features together, whose sums come to the driver and go to the tasks.
RANGES, CELLS = 1 << 12, 1 << 18
#: Nodes with fewer ranges, or with fewer values in a range, are counted value by value at once.
LEAST_RANGES, RANGE_ROWS = 64, 16
#: The ways to deal a range's classes are twice as many for each class; beyond so many classes values are counted at once.
DEALT_CLASSES = 8
#: A range is left out if it falls short of the best split by more than this share, far more than sums can be rounded by.
SLACK = 1e-9


@dataclass
class Rules:
    """When a node is split, as the parameters of a tree say, for all trees. seeds: one for each tree."""

    max_depth: int | None
    min_samples_split: int
    min_samples_leaf: int
    min_weight_fraction_leaf: float
    subset: int
    min_impurity_decrease: float
    seeds: Sequence[int]
    #: Whether nodes try some of the features only.
    draws: bool


@dataclass
class Node:
    weights: list[float]
    rows: int
    #: Features that are known to have one value here, as they had above.
    constant: frozenset[int] = frozenset()
    left: int = -1
    right: int = -1
    feature: int = -2
    threshold: float = -2.0
    weight: float = field(init=False)
    impurity: float = field(init=False)

    def __post_init__(self) -> None:
        self.weight = sum(self.weights)
        self.impurity = 1.0 - sum(w * w for w in self.weights) / (self.weight * self.weight) if self.weight else 0.0


def draw(seed: int, node: int, features: int) -> list[int]:
    """All features in the random order in which a node tries them."""
    return np.random.default_rng([seed & 0xFFFFFFFF, node]).permutation(features).tolist()


def flat(features: int) -> list[Column]:
    """x0, x1, ... of an array x: columns of their own are read faster."""
    return [F.get("x", F.lit(i)).alias(f"x{i}") for i in range(features)]


def grow(rows: DataFrame, features: int, classes: int, rules: Rules) -> list[list[Node]]:
    """The nodes of each tree, in the order in which they were found.

    rows: (x0 double, x1 double, ..., y int, w double, trees array<int>, times array<int>): the features
    as float32 values, the class, the weight, and how often which trees' samples hold the row; without
    trees and times all hold it once; or an array x for x0, x1, .... They are read up to four times for each level, so they should be
    a written table.

    A node tries features in a random order until rules.subset are tried and one of them isn't
    constant; those that are known to be constant from the nodes above count as tried, and aren't
    looked at again. The nodes come to the driver: they are the model.
    """
    if "x" in rows.columns:
        rows = rows.select(*flat(features), *[c for c in rows.columns if c != "x"])
    count = len(rules.seeds)
    samples = F.arrays_zip("trees", "times") if "trees" in rows.columns else F.array(*[F.struct(F.lit(t).alias("trees"), F.lit(1).alias("times")) for t in range(count)])
    spread = rows.select("y", "w", F.explode(samples).alias("t"))
    roots = spread.groupBy("t.trees", "y").agg(F.sum(F.col("w") * F.col("t.times")).alias("w"), F.count(F.lit(1)).alias("n")).collect()  # a row for each tree and class
    start = [([0.0] * classes, 0) for _ in range(count)]
    for t, y, w, n in roots:
        start[t][0][y] = w
        start[t] = (start[t][0], start[t][1] + n)
    trees = [[Node(w, n)] if sum(w) else [] for w, n in start]
    total = [t[0].weight if t else 0.0 for t in trees]
    least, depth = max(rules.min_samples_split, 2 * rules.min_samples_leaf), 0
    borders = _borders(rows, features, max((t[0].rows for t in trees if t), default=0)) if classes <= DEALT_CLASSES else None
    frontier = [(t, 0) for t in range(count) if trees[t]]
    while frontier and (rules.max_depth is None or depth < rules.max_depth):
        enough = lambda t, x: x.rows >= least and x.weight >= 2 * rules.min_weight_fraction_leaf * total[t] and x.impurity > EPSILON
        open_ = [(t, i) for t, i in frontier if enough(t, trees[t][i]) and len(trees[t][i].constant) < features]
        frontier = []
        orders = [draw(rules.seeds[t], i, features) if rules.draws else list(range(features)) for t, i in open_]
        tried = [[p for p in order[: rules.subset] if p not in trees[t][i].constant] for order, (t, i) in zip(orders, open_, strict=True)]
        splits, again = {}, []
        for slot, split, constant in _level(rows, trees, open_, tried, classes, rules, total, borders):
            node = trees[open_[slot][0]][open_[slot][1]]
            node.constant |= constant
            if split is not None:
                splits[slot] = split
            elif len(constant) == len(tried[slot]) and len(node.constant) < features:
                again.append(slot)
        # nodes in which all of these are constant: the next feature that isn't
        rest = [[p for p in orders[s][rules.subset :] if p not in trees[open_[s][0]][open_[s][1]].constant] for s in again]
        for k, split, constant in _level(rows, trees, [open_[s] for s in again], rest, classes, rules, total, borders, first_only=True):
            trees[open_[again[k]][0]][open_[again[k]][1]].constant |= constant
            if split is not None:
                splits[again[k]] = split
        for slot in sorted(splits):
            t, i = open_[slot]
            frontier += _settle(trees[t], i, splits[slot], total[t], t, rules)
        if (size := sum(map(len, trees))) > MODEL_NODES:
            raise ValueError(f"the model has {size} nodes at depth {depth + 1}: limit max_depth, or ask for larger leaves")
        depth += 1
        frontier.sort()
    return trees


def _settle(nodes: list[Node], at: int, s, total: float, tree: int, rules: Rules) -> list[tuple[int, int]]:
    """Make the split unless it gains too little; the new open nodes."""
    node = nodes[at]
    gain = node.weight / total * (node.impurity - s.nr / s.n * s.impurity_right - s.nl / s.n * s.impurity_left)
    if gain + EPSILON < rules.min_impurity_decrease:
        return []
    node.feature, node.threshold, node.left, node.right = s.place, s.threshold, len(nodes), len(nodes) + 1
    nodes += [Node(list(s.left_weights), s.cl, node.constant), Node(list(s.right_weights), s.cr, node.constant)]
    return [(tree, node.left), (tree, node.right)]


def _level(rows: DataFrame, trees: list[list[Node]], open_: list[tuple[int, int]], tried: list[list[int]], classes: int, rules: Rules, total: list[float], borders: list[np.ndarray] | None, first_only: bool = False) -> Iterator[tuple]:
    """(slot, best split or None, features found constant) of each open node, from one pass over the rows, or two if they are counted by ranges first.

    first_only: of the features only the first that isn't constant counts.
    """
    if not any(tried):
        yield from ((slot, None, frozenset()) for slot in range(len(open_)))
        return
    least = np.array([rules.min_weight_fraction_leaf * total[t] for t, _ in open_])
    most = sum(trees[t][i].rows * len(own) for (t, i), own in zip(open_, tried, strict=True))
    pairs = sum(map(len, tried))
    ranges = min(RANGES, CELLS // pairs - 1)
    if borders and ranges >= LEAST_RANGES and most >= RANGE_ROWS * ranges * pairs:
        cells = _Cells(open_, tried, [b[:: -(-len(b) // ranges) if len(b) else 1] for b in borders])
        found, spans = _by_ranges(rows, trees, cells, classes, rules, least, first_only)
    else:
        found = candidates(_counted(rows, trees, open_, tried, classes, most), classes)
        # a row for each node and feature that it tries; a node that tries all needn't know which are constant
        spans = {(r.node, r.place): (r.low, r.high) for r in found.spans.collect()} if rules.draws else {}
    constant = _constant(tried, spans) if rules.draws else [frozenset()] * len(open_)
    rated = found.rated
    if rules.min_weight_fraction_leaf:
        # a row for each node: the size of a level of the model
        weights = rows.sparkSession.createDataFrame(list(enumerate(least.tolist())), "node int, least double")
        rated = rated.join(F.broadcast(weights), "node").where((F.col("nl") >= F.col("least")) & (F.col("nr") >= F.col("least"))).drop("least")
    if first_only:
        firsts = [(slot, next(p for p in own if p not in constant[slot])) for slot, own in enumerate(tried) if any(p not in constant[slot] for p in own)]
        if firsts:
            rated = rated.join(F.broadcast(rows.sparkSession.createDataFrame(firsts, "node int, place int")), ["node", "place"], "left_semi")
    best = {s.node: s for s in best_split(rated, "node", rules.min_samples_leaf).collect()}  # the model's splits
    for slot in range(len(open_)):
        skipped = frozenset()
        if first_only:
            before = tried[slot][: next((k for k, p in enumerate(tried[slot]) if p not in constant[slot]), len(tried[slot]))]
            skipped = constant[slot] - frozenset(before)
        yield slot, best.get(slot), constant[slot] - skipped


def _constant(tried: list[list[int]], spans: dict[tuple[int, int], tuple[float, float]]) -> list[frozenset[int]]:
    """The features that each node tries and finds to have one value."""
    return [frozenset(p for p in own if (slot, p) in spans and not spans[slot, p][1] - spans[slot, p][0] > GAP) for slot, own in enumerate(tried)]


def _entries(rows: DataFrame, trees: list[list[Node]], open_: list[tuple[int, int]], tried: list[list[int]]):
    """(columns, a function of a batch of them: (slot, place, value, class, weight) of each feature that an open node of a row tries, in blocks)."""
    model, first, slots = _arrays(trees, open_)
    places = np.full((len(open_), max(map(len, tried))), -1, np.int64)
    for slot, own in enumerate(tried):
        places[slot, : len(own)] = own
    wanted = sorted({t for t, _ in open_})
    xs, more = [c for c in rows.columns if c[0] == "x"], [c for c in ("trees", "times") if c in rows.columns]

    def entries(whole: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            n = b.num_rows
            x = np.stack([b[c].to_numpy() for c in xs], 1)
            y, w, held = b["y"].to_numpy(), b["w"].to_numpy(), np.ones((n, len(first)))
            if more:
                held[:] = 0
                held[np.repeat(np.arange(n), b["trees"].value_lengths().to_numpy()), b["trees"].flatten().to_numpy()] = b["times"].flatten().to_numpy()
            here = model.leaves(x)
            for t in wanted:
                slot = slots[here[:, t]]
                r = np.flatnonzero((slot >= 0) & (held[:, t] > 0))
                if not len(r):
                    continue
                own = places[slot[r]]
                k, j = np.nonzero(own >= 0)
                rr, place = r[k], own[k, j]
                yield slot[rr], place, x[rr, place], y[rr], w[rr] * held[rr, t]

    return [*xs, "y", "w", *more], entries


def _counted(rows: DataFrame, trees: list[list[Node]], open_: list[tuple[int, int]], tried: list[list[int]], classes: int, most: int, cells: _Cells | None = None, kept: np.ndarray | None = None) -> DataFrame:
    """(node, place, value, c, n0, ...): rows and class weights of every value of the tried features of each open node; node is its slot.

    kept: whether the values of each cell count; then node is the cell.
    """
    read, entries = _entries(rows, trees, open_, tried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, place, x, y, w in entries(b):
                if cells is not None:
                    node = cells.of(node, place, x)
                    own = kept[node]
                    node, place, x, y, w = node[own], place[own], x[own], y[own], w[own]
                node, place, value, c, sums = tallied(node, place, x, y, w, classes)
                yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(value), pa.array(c), *map(pa.array, sums)], names)

    names = ["node", "place", "value", "c", *[f"n{k}" for k in range(classes)]]
    tallies = rows.select(*read).mapInArrow(run, "node int, place int, value double, c long, " + ", ".join(f"n{k} double" for k in range(classes)))
    return cut(summed(tallies, classes, most))


def _borders(rows: DataFrame, features: int, n: int) -> list[np.ndarray] | None:
    """Borders of ranges of each feature's values, about equally full; None for a table too small for ranges.

    They are taken from some rows, as Spark's range partitioning does. All rows are counted whatever
    the borders are: these decide only how many values must be counted one by one.
    """
    ranges = min(RANGES, CELLS // features)
    if n < RANGE_ROWS * ranges or ranges < LEAST_RANGES:
        return None
    some = rows.select(*[f"x{i}" for i in range(features)]).sample(min(1.0, RANGE_ROWS * ranges / n), 1).toArrow()
    x = np.sort(np.stack([some[c].to_numpy() for c in some.column_names], 1), axis=0)
    return [np.unique(x[len(x) // (2 * ranges) :: max(1, len(x) // ranges), p]) for p in range(x.shape[1])]


class _Cells:
    """Numbers for the ranges of the features that open nodes try: those of a node and feature follow each other."""

    def __init__(self, open_: list[tuple[int, int]], tried: list[list[int]], borders: list[np.ndarray]):
        self.open, self.tried, self.borders = open_, tried, borders
        self.pairs = [(slot, p) for slot, own in enumerate(tried) for p in own]
        self.first = np.cumsum([0, *(len(borders[p]) + 1 for _, p in self.pairs)])
        self.size = int(self.first[-1])
        self.at = np.full((len(open_), len(borders)), -1, np.int64)
        for k, (slot, p) in enumerate(self.pairs):
            self.at[slot, p] = self.first[k]

    def of(self, slot: np.ndarray, place: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The cell of each value; a border is the largest value of its range."""
        cell = self.at[slot, place]
        for p in np.unique(place):
            own = place == p
            cell[own] += np.searchsorted(self.borders[p], x[own])
        return cell


def _histogram(rows: DataFrame, trees: list[list[Node]], cells: _Cells, classes: int) -> tuple[np.ndarray, ...]:
    """(rows, least value, largest value, class weights) of each cell: a task sends one row for each cell that it finds, and CELLS at most come to the driver."""
    read, entries = _entries(rows, trees, cells.open, cells.tried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, low, high, n = np.zeros(cells.size, np.int64), np.full(cells.size, np.inf), np.full(cells.size, -np.inf), np.zeros(cells.size * classes)
        for b in batches:
            for slot, place, x, y, w in entries(b):
                cell = cells.of(slot, place, x)
                np.minimum.at(low, cell, x)
                np.maximum.at(high, cell, x)
                np.add.at(c, cell, 1)
                np.add.at(n, cell * classes + y, w)
        own = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(c[own]), pa.array(low[own]), pa.array(high[own]), *[pa.array(n[own * classes + k]) for k in range(classes)]], names)

    sums = [f"n{k}" for k in range(classes)]
    names = ["cell", "c", "low", "high", *sums]
    found = rows.select(*read).mapInArrow(run, "cell long, c long, low double, high double, " + ", ".join(f"{s} double" for s in sums))
    table = found.groupBy("cell").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(s).alias(s) for s in sums]).toArrow()
    at = table["cell"].to_numpy()
    c, low, high, n = np.zeros(cells.size, np.int64), np.full(cells.size, np.inf), np.full(cells.size, -np.inf), np.zeros((cells.size, classes))
    c[at], low[at], high[at] = table["c"].to_numpy(), table["low"].to_numpy(), table["high"].to_numpy()
    n[at] = np.stack([table[s].to_numpy() for s in sums], 1) if len(at) else np.zeros((0, classes))
    return c, low, high, n


def _proxy(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What best_split() compares, of class weights on both sides; a side without weight adds nothing."""
    side = lambda w: np.divide((w * w).sum(-1), w.sum(-1), out=np.zeros(w.shape[:-1]), where=w.sum(-1) > 0)
    return side(left) + side(np.maximum(right, 0))


def _by_ranges(rows: DataFrame, trees: list[list[Node]], cells: _Cells, classes: int, rules: Rules, least: np.ndarray, first_only: bool) -> tuple[Candidates, dict[tuple[int, int], tuple[float, float]]]:
    """(thresholds among which each node's best is, the span of each node's features).

    These are the best borders, and all thresholds inside ranges that could hold a better one. The
    proxy is convex in the weights to the left, so inside a range it is at most what it is where each
    class lies wholly on one side.
    """
    c, low, high, n = _histogram(rows, trees, cells, classes)
    spans, lines = {}, []
    for k, (slot, p) in enumerate(cells.pairs):
        full = cells.first[k] + np.flatnonzero(c[cells.first[k] : cells.first[k + 1]])
        if len(full):
            spans[slot, p] = (low[full[0]], high[full[-1]])
            lines.append((slot, p, full))
    constant = _constant(cells.tried, spans)
    only = {slot: next((p for p in own if p not in constant[slot]), None) for slot, own in enumerate(cells.tried)} if first_only else {}
    lines = [x for x in lines if not first_only or only[x[0]] == x[1]]
    best, between = np.full(len(cells.open), -np.inf), []
    for slot, p, full in lines:
        left, cl = np.cumsum(n[full], axis=0), np.cumsum(c[full])
        all_, right, cr = left[-1], left[-1] - left, cl[-1] - cl
        i = np.flatnonzero(low[full[1:]] - high[full[:-1]] > GAP)
        i = i[(cl[i] >= rules.min_samples_leaf) & (cr[i] >= rules.min_samples_leaf) & (left[i].sum(1) >= least[slot]) & (right[i].sum(1) >= least[slot])]
        proxy = _proxy(left[i], right[i])
        best[slot] = max(best[slot], proxy.max(initial=-np.inf))
        between.append((i, proxy, left, cl, all_))
    starts, borders, kept = [], [], np.zeros(cells.size, bool)
    for (slot, p, full), (i, proxy, left, cl, all_) in zip(lines, between, strict=True):
        enough = best[slot] - SLACK * abs(best[slot]) if np.isfinite(best[slot]) else -np.inf
        j = i[proxy >= enough]
        same = lambda j, *values: np.tile(np.array(values, float), (len(j), 1))
        borders.append(np.column_stack([same(j, slot, p), high[full[j]], low[full[j + 1]], cl[j], left[j], same(j, cl[-1], *all_)]))
        with np.errstate(invalid="ignore"):  # a range of nothing but an infinity has no width
            wide = np.flatnonzero(high[full] - low[full] > GAP)
        before = left[wide] - n[full[wide]]
        most = np.full(len(wide), -np.inf)
        for dealt in range(1 << classes):
            at = before + n[full[wide]] * np.array([dealt >> k & 1 for k in range(classes)])
            most = np.maximum(most, _proxy(at, all_ - at))
        j, cell = wide[most >= enough], full[wide[most >= enough]]
        kept[cell] = True
        starts.append(np.column_stack([cell, same(j, slot), cl[j] - c[cell], left[j] - n[cell], same(j, cl[-1], *all_)]))
    spark, sums = rows.sparkSession, ["c", *[f"n{k}" for k in range(classes)]]
    named = lambda lines, *names: spark.createDataFrame(pa.table(dict(zip(names, np.concatenate([np.zeros((0, len(names))), *lines]).T, strict=True))))
    found = named(borders, "node", "place", "value", "above", *(f"l_{s}" for s in sums), *(f"t_{s}" for s in sums)).withColumns({k: F.col(k).cast("int") for k in ("node", "place")})
    if kept.any():
        # a row for each range that is left, of CELLS at most
        at = named(starts, "cell", "slot", *(f"b_{s}" for s in sums), *(f"a_{s}" for s in sums)).withColumns({k: F.col(k).cast("int") for k in ("cell", "slot")})
        inside = scanned(_counted(rows, trees, cells.open, cells.tried, classes, int(c[kept].sum()), cells, kept), ["node", "place"], "value", sums, GAP)
        inside = inside.join(F.broadcast(at), F.col("node") == F.col("cell"))
        found = found.unionByName(inside.select(F.col("slot").alias("node"), "place", "value", "above", *[(F.col(f"l_{s}") + F.col(f"b_{s}")).alias(f"l_{s}") for s in sums], *[F.col(f"a_{s}").alias(f"t_{s}") for s in sums]))
    return Candidates(rated_rows(found, classes, "node"), None), spans


def _arrays(trees: list[list[Node]], open_: list[tuple[int, int]]) -> tuple[Compiled, np.ndarray, np.ndarray]:
    """(the trees so far as node arrays, the places of the roots, each place's slot among the open nodes or -1)."""
    first = np.cumsum([0, *(max(1, len(t)) for t in trees)])
    size = int(first[-1])
    left, right, feature, threshold, slots = np.full(size, -1), np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.full(size, -1)
    for t, nodes in enumerate(trees):
        for i, node in enumerate(nodes):
            if node.left >= 0:
                at = first[t] + i
                left[at], right[at], feature[at], threshold[at] = first[t] + node.left, first[t] + node.right, node.feature, node.threshold
    for slot, (t, i) in enumerate(open_):
        slots[first[t] + i] = slot
    return Compiled(np.arange(len(trees)), first[:-1], left, right, feature, threshold, np.zeros(0), np.zeros((0, 0))), first[:-1], slots


def node_table(df: DataFrame, trees: list[list[Node]], features: Sequence[str]) -> DataFrame:
    """The nodes of all trees, each numbered in pre-order, with `feature_name`; decrease is the impurity, by weight, that a split takes off."""
    out: list[tuple] = []
    for tree, nodes in enumerate(trees):
        base, stack = len(out), [(0, None, 0)] if nodes else []  # node, row of its parent, which child
        while stack:
            at, parent, side = stack.pop()
            node, number = nodes[at], len(out) - base
            if parent is not None:
                out[parent] = (*out[parent][: 2 + side], number, *out[parent][3 + side :])
            leaf = node.left < 0
            decrease = 0.0 if leaf else node.weight * node.impurity - sum(nodes[c].weight * nodes[c].impurity for c in (node.left, node.right))
            out.append((tree, number, -1, -1, -2 if leaf else node.feature, -2.0 if leaf else node.threshold, node.impurity, node.rows, node.weight, [w / node.weight for w in node.weights], decrease, None if leaf else features[node.feature]))
            if not leaf:
                stack += [(node.right, base + number, 1), (node.left, base + number, 0)]
    return df.sparkSession.createDataFrame(out, NODE_SCHEMA + ", feature_name string")
