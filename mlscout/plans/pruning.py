"""Cost-complexity pruning of a decision tree: the nested subtrees of one deep tree.

Spark grows one deep tree. Read from its root, every internal node has a price: the risk (squared
error, or rows classified wrongly) that its subtree saves per leaf it adds. The cheapest nodes
are collapsed first, again and again, which gives a nested sequence of subtrees, each the best
for a range of complexities. A subtree needs no growing: the deep tree tells the leaf of a row,
and the leaf tells the value of the node that it now belongs to. A tree of smaller depth is a
subtree of the deep one as well, so all settings of a fold share one tree.

Only the tree is on the driver, at most 2^depth nodes, never rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlscout.operators.task import REGRESSION

SEED = 123
LEAF = "_leaf"


@dataclass
class Node:
    """A node of the deep tree; ``leaves`` is the range of its leaf numbers, left to right."""

    depth: int
    parent: int | None
    prediction: float
    counts: list[float]
    risk: float
    gain: float = 0.0
    feature: int | None = None
    children: list[int] = field(default_factory=list)
    leaves: tuple[int, int] = (0, 0)


def read_tree(model: Any, task_type: str) -> list[Node]:
    """The nodes of a fitted tree, parents before children."""
    nodes: list[Node] = []
    n_leaves = 0

    def visit(node: Any, depth: int, parent: int | None) -> int:
        nonlocal n_leaves
        stats = list(node.impurityStats().stats())
        if task_type == REGRESSION:
            count, counts = stats[0], []
            risk = max(0.0, node.impurity() * count)
        else:
            count, counts = sum(stats), stats
            risk = count - max(stats, default=0.0)
        at = len(nodes)
        nodes.append(Node(depth, parent, node.prediction(), counts, risk))
        begin = n_leaves
        if node.subtreeDepth() > 0:
            nodes[at].gain = node.gain() * count
            nodes[at].feature = node.split().featureIndex()
            nodes[at].children = [visit(node.leftChild(), depth + 1, at), visit(node.rightChild(), depth + 1, at)]
        else:
            n_leaves += 1
        nodes[at].leaves = (begin, n_leaves)
        return at

    visit(model._call_java("rootNode"), 0, None)
    return nodes


def weakest_links(nodes: Sequence[Node], depth: int | None = None) -> list[tuple[float, list[int], int]]:
    """(complexity, nodes collapsed at it, leaves left) of the nested subtrees, largest first.

    A complexity is the price of a leaf as a share of the risk of the root. ``depth`` cuts the
    tree before. The first entry is the tree as it is, at complexity 0 or below every price.
    """
    inner = [bool(n.children) and (depth is None or n.depth < depth) for n in nodes]
    risk, leaves, below = [n.risk for n in nodes], [1] * len(nodes), [0.0] * len(nodes)
    for i in reversed(range(len(nodes))):
        below[i] = risk[i]
        if inner[i]:
            below[i] = sum(below[c] for c in nodes[i].children)
            leaves[i] = sum(leaves[c] for c in nodes[i].children)

    def price(i: int) -> float:
        return max(0.0, risk[i] - below[i]) / (leaves[i] - 1)

    alive = list(inner)
    for i, n in enumerate(nodes):  # what lies below the depth asked for is not there
        if n.parent is not None and not alive[n.parent]:
            alive[i] = False
    heap = [(price(i), -i) for i in range(len(nodes)) if alive[i]]
    heapq.heapify(heap)
    whole = risk[0] or 1.0
    out: list[tuple[float, list[int], int]] = [(0.0, [], leaves[0])]
    while heap:
        cost, i = heapq.heappop(heap)
        i = -i
        if not alive[i] or cost != price(i):
            continue  # collapsed with a node above, or its price has changed since
        saved, lost, at = risk[i] - below[i], leaves[i] - 1, i
        gone = [i]
        while gone:
            j = gone.pop()
            alive[j] = False
            gone += [c for c in nodes[j].children if alive[c]]
        below[i], leaves[i] = risk[i], 1
        while nodes[at].parent is not None:
            at = nodes[at].parent
            below[at], leaves[at] = below[at] + saved, leaves[at] - lost
            heapq.heappush(heap, (price(at), -at))
        complexity = max(cost / whole, out[-1][0])  # rounding must not undo the order
        if out[-1][1] and complexity <= out[-1][0] * (1 + 1e-12):
            out[-1] = (out[-1][0], [*out[-1][1], i], leaves[0])
        else:
            out.append((complexity, [i], leaves[0]))
    return out


def pruned(nodes: Sequence[Node], complexity: float, depth: int | None = None) -> list[bool]:
    """Whether each node still splits in the smallest subtree that is best at ``complexity``."""
    splits = [bool(n.children) and (depth is None or n.depth < depth) for n in nodes]
    for at, collapsed, _ in weakest_links(nodes, depth):
        if at <= complexity:
            for i in collapsed:
                splits[i] = False
    for i, n in enumerate(nodes):
        if n.parent is not None and not splits[n.parent]:
            splits[i] = False
    return splits


class PrunedLeaves(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Prediction and probabilities of a subtree, by the leaf of the deep tree."""

    predictions = Param(Params._dummy(), "predictions", "by leaf", TypeConverters.toListFloat)
    chances = Param(Params._dummy(), "chances", "class probabilities, leaf by leaf", TypeConverters.toListFloat)
    importances = Param(Params._dummy(), "importances", "by feature", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, predictions=None, chances=None, importances=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        own = self.getOrDefault(self.predictions)
        value = F.get(F.array(*map(F.lit, own)), F.col(LEAF).cast("int"))
        out = df.withColumn("prediction", value)
        flat = self.getOrDefault(self.chances)
        if flat:
            width = len(flat) // len(own)
            rows = [F.array(*map(F.lit, flat[i : i + width])) for i in range(0, len(flat), width)]
            out = out.withColumn("probability", F.get(F.array(*rows), F.col(LEAF).cast("int")))
        return out.drop(LEAF, "rawPrediction")


def subtree(model: Any, nodes: Sequence[Node], splits: Sequence[bool], n_inputs: int) -> PipelineModel:
    """The deep tree with the values of a subtree."""
    n_leaves = nodes[0].leaves[1]
    predictions, chances = [0.0] * n_leaves, [[]] * n_leaves
    importances = [0.0] * n_inputs
    for i, n in enumerate(nodes):
        if splits[i]:
            importances[n.feature] += n.gain
        elif n.parent is None or splits[n.parent]:
            total = sum(n.counts)
            for leaf in range(*n.leaves):
                predictions[leaf] = n.prediction
                chances[leaf] = [c / total for c in n.counts] if total else []
    whole = sum(importances) or 1.0
    values = PrunedLeaves(
        predictions=predictions,
        chances=[c for row in chances for c in row],
        importances=[x / whole for x in importances],
    )
    return PipelineModel([model, values])


def deep_tree(task_type: str, depth: int) -> DecisionTreeRegressor | DecisionTreeClassifier:
    tree = DecisionTreeRegressor if task_type == REGRESSION else DecisionTreeClassifier
    return tree(maxDepth=int(depth), seed=SEED, leafCol=LEAF)


def pruned_trees(
    features: DataFrame, task_type: str, settings: Sequence[dict[str, Any]], n_inputs: int
) -> list[PipelineModel]:
    """One model per setting (``cp``, ``depth``), all from a single tree grown on ``features``."""
    model = deep_tree(task_type, max(s["depth"] for s in settings)).fit(features)
    nodes = read_tree(model, task_type)
    return [subtree(model, nodes, pruned(nodes, s["cp"], int(s["depth"])), n_inputs) for s in settings]


def pruning_table(features: DataFrame, task_type: str, depth: int) -> list[tuple[int, float, int]]:
    """(step, complexity, leaves) of the nested subtrees of a tree of ``depth``."""
    model = deep_tree(task_type, depth).fit(features)
    steps = weakest_links(read_tree(model, task_type))
    return [(i, complexity, leaves) for i, (complexity, _, leaves) in enumerate(steps)]
