"""Forests as node arrays: rows descend all trees at once inside an expression or an Arrow batch, whatever the depth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Nodes that are sent to every task at once, about 100 bytes each; a larger model is split by its trees.
BROADCAST_NODES = 400_000


@dataclass
class Compiled:
    """The nodes of several trees, one tree after another; children are places in these arrays, -1 in a leaf.

    Roots are at `first`. `values` has a row of class shares for each node.
    """

    trees: np.ndarray
    first: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    node: np.ndarray
    values: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The place of the leaf that each row reaches in each tree; values above the threshold, and NaN, go right."""
        at = np.broadcast_to(self.first, (len(x), len(self.first))).copy()
        rows, trees = np.nonzero(self.left[at] >= 0)
        while len(rows):
            here = at[rows, trees]
            here = np.where(x[rows, self.feature[here]] <= self.threshold[here], self.left[here], self.right[here])
            at[rows, trees] = here
            inner = self.left[here] >= 0
            rows, trees = rows[inner], trees[inner]
        return at

    def shares(self, x: np.ndarray) -> np.ndarray:
        """The sum over the trees, in their order, of the class shares that each row finds."""
        at = self.leaves(x)
        total = np.zeros((len(x), self.values.shape[1]))
        for t in range(len(self.first)):
            total += self.values[at[:, t]]
        return total

    def depth(self) -> int:
        deep, level = 0, self.first[self.left[self.first] >= 0]
        while len(level):
            deep += 1
            level = np.concatenate([self.left[level], self.right[level]])
            level = level[self.left[level] >= 0]
        return deep


def compiled(nodes: DataFrame, most: int = BROADCAST_NODES) -> Iterator[Compiled]:
    """The model in groups of whole trees with at most `most` nodes each; a tree that is larger alone is an error."""
    sizes = nodes.groupBy("tree_id").count().orderBy("tree_id").collect()  # a row for each tree
    groups: list[list[int]] = []
    room = 0
    for tree, n in sizes:
        if n > most:
            raise ValueError(f"tree {tree} has {n} nodes, more than the {most} that are sent to a task")
        if n > room:
            groups.append([])
            room = most
        groups[-1].append(tree)
        room -= n
    columns = ["tree_id", "node_id", "left", "right", "feature", "threshold", "value"]
    for trees in groups:
        table = nodes.where(nodes["tree_id"].between(trees[0], trees[-1])).select(*columns).toArrow().sort_by([("tree_id", "ascending"), ("node_id", "ascending")])
        yield _of(table)


def _of(table: pa.Table) -> Compiled:
    tree, node, left, right, feature, threshold = (table[c].to_numpy() for c in table.column_names[:6])
    trees, first = np.unique(tree, return_index=True)
    place = {(t, n): i for i, (t, n) in enumerate(zip(tree.tolist(), node.tolist(), strict=True))}
    child = lambda side: np.fromiter((place[t, c] if c >= 0 else -1 for t, c in zip(tree.tolist(), side.tolist(), strict=True)), np.int64, len(tree))
    width = max(map(len, table["value"].to_pylist()), default=0)
    values = np.zeros((len(tree), width))
    for i, v in enumerate(table["value"].to_pylist()):
        values[i, : len(v)] = v
    roots = np.array([place[t, 0] for t in trees.tolist()], np.int64)
    return Compiled(trees, roots if len(roots) else first, child(left), child(right), feature.astype(np.int64), threshold.astype(float), node, values)


def matrix(columns: Sequence) -> np.ndarray:
    """Feature columns of an Arrow batch or pandas series as rows of float32 values, held as doubles; a null is NaN."""
    arrays = [c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy() for c in columns]
    return np.stack([np.asarray(a, float).astype(np.float32) for a in arrays], axis=1).astype(float) if arrays else np.zeros((0, 0))
