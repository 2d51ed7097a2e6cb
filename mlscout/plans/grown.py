"""Forests and boosted trees grown from cells: rows that share all bins of their features.

A tree sees a feature through at most ``BINS`` bins (a forest through 32, as Spark's; boosted trees
keep theirs in all rounds, where Spark draws 32 anew each round). Two passes over the rows, one for the bins and
one for the cells, give sums per cell (rows per class, or rows and sum of the label); a split needs
nothing else. Cells are at most the product of the bins and never more than the rows; every level
of the trees is one pass over the cells, whose histograms add up in a tree of tasks. What reaches
the driver is a histogram of the nodes of a level, whatever the number of rows.

Drawing every row of a cell by a Poisson law, as bagging does, draws the sum of the cell: counts of
a class are drawn per cell, sums of a label row by row on the way into the cell.

The laws are those of Spark's forests (impurity Gini or variance, a share of the features per node)
and boosted trees (the first tree learns the label, the others the slope of the loss).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlscout.operators.task import REGRESSION

BINS = 64  # six bits each
DIGITS = 10  # bins in one 64-bit word
FOREST_BINS = 32
POINTS = 4096  # values kept of a feature to place its bins; exact up to as many
BLOCK_ROWS = 1 << 19
BAG_TREES = 20  # trees that share a pass over the rows
STATE_CELLS = 1 << 22  # histogram cells of a pass
CELLS_PER_TASK = 50_000
FAN_IN = 64
REFRESH = 10  # boosting rounds after which margins are stored
TABLE_CELLS = 1 << 20  # scores a worker remembers
STORAGE = StorageLevel.MEMORY_AND_DISK


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of at least ``size`` rows at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append((_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
        if n >= size:
            yield tuple(np.concatenate(parts) for parts in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(parts) for parts in zip(*held))


# -- bins ---------------------------------------------------------------------


def _thinned(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``POINTS`` values in order, each counting for those between it and the one before."""
    values, where = np.unique(values, return_inverse=True)
    counts = np.bincount(where, weights=counts, minlength=len(values))
    if len(values) <= POINTS:
        return values, counts
    group = np.minimum(np.cumsum(counts) * POINTS / counts.sum(), POINTS - 1).astype(int)
    last = np.append(np.flatnonzero(np.diff(group)), len(group) - 1)
    return values[last], np.diff(np.append(0.0, np.cumsum(counts)[last]))


def _merged(parts: list[bytes]) -> bytes:
    """Summaries of one feature put together: values, then counts."""
    pairs = [np.frombuffer(raw).reshape(2, -1) for raw in parts]
    return np.concatenate(_thinned(*(np.concatenate(x) for x in zip(*pairs)))).tobytes()


def _cuts(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between values: all if they fit, else near equal shares of the rows."""
    middle = (values[:-1] + values[1:]) / 2
    # far values may meet in rounding: a threshold stays below the value above it
    middle = np.where(middle < values[1:], middle, values[:-1])
    if len(middle) < bins:
        return middle
    ends = np.cumsum(counts)
    at = [np.abs(ends[:-1] - ends[-1] * i / bins).argmin() for i in range(1, bins)]
    return middle[np.unique(at)]


def find_cuts(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Thresholds per feature; missing values lie above all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for x, _ in _blocks(batches, BLOCK_ROWS):
            for j in range(x.shape[1]):
                column = x[:, j][np.isfinite(x[:, j])] + 0.0
                part = np.concatenate(_thinned(column, np.ones(len(column)))).tobytes()
                if j < len(held):
                    held[j] = _merged([held[j], part])
                else:
                    held.append(part)
        if held:
            arrays = [pa.array(range(len(held)), pa.int32()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["feature", "state"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        for batch in batches:
            for j, raw in zip(*(c.to_pylist() for c in batch.columns)):
                held[j] = _merged([held[j], raw]) if j in held else raw
        if held:
            arrays = [pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["feature", "state"])

    schema = "feature int, state binary"
    found: dict[int, list[bytes]] = {}
    for r in _few(rows.mapInArrow(run, schema)).mapInArrow(joined, schema).collect():
        found.setdefault(r.feature, []).append(bytes(r.state))
    if not found:
        raise ValueError("there are no rows to learn from")
    return [_cuts(*np.frombuffer(_merged(found[j])).reshape(2, -1), bins) for j in sorted(found)]


def _few(states: DataFrame) -> DataFrame:
    return states.repartition(min(FAN_IN, states.sparkSession.sparkContext.defaultParallelism))


# -- cells --------------------------------------------------------------------


def _words(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Bins of all features, six bits each, packed into words."""
    words = [np.zeros(len(x), np.int64) for _ in range(-(-len(cuts) // DIGITS))]
    for j, cut in enumerate(cuts):
        words[j // DIGITS] |= np.searchsorted(cut, x[:, j]).astype(np.int64) << 6 * (j % DIGITS)
    return words


def _bins(words: list[np.ndarray], n: int) -> np.ndarray:
    return np.stack([words[j // DIGITS] >> 6 * (j % DIGITS) & 63 for j in range(n)])


def _numbered(words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of words and the number of each row's."""
    if len(words) == 1:
        one, where = np.unique(words[0], return_inverse=True)
        return [one], where
    some, where = np.unique(np.stack(words, axis=1), axis=0, return_inverse=True)
    return list(some.T), where.ravel()


def cells_of(rows: DataFrame, cuts: list[np.ndarray], n_classes: int, bags: int = 0, seed: int = 0) -> DataFrame:
    """Words and sums per cell: rows of each class, or (rows, sum of the label), once per bag if
    there are any. ``n_classes`` is 0 for a numeric label."""
    n_words = -(-len(cuts) // DIGITS)
    n_sums = n_classes or 2 * max(bags, 1)
    names = [f"w{i}" for i in range(n_words)] + [f"s{i}" for i in range(n_sums)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for x, y in _blocks(batches, BLOCK_ROWS):
            words, where = _numbered(_words(x, cuts))
            n, sums = len(words[0]), []
            if n_classes:
                both = np.bincount(where * n_classes + y.astype(np.int64), minlength=n * n_classes)
                sums = list(both.reshape(n, n_classes).T.astype(float))
            for _ in range(0 if n_classes else max(bags, 1)):
                drawn = random.poisson(1.0, len(y)).astype(float) if bags else np.ones(len(y))
                sums.append(np.bincount(where, weights=drawn, minlength=n))
                sums.append(np.bincount(where, weights=drawn * y, minlength=n))
            for at in range(0, n, 10_000):
                arrays = [pa.array(a[at : at + 10_000]) for a in [*words, *sums]]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = ", ".join(f"{c} {'long' if c[0] == 'w' else 'double'}" for c in names)
    keys = names[:n_words]
    sums = [F.sum(c).alias(c) for c in names[n_words:]]
    return rows.mapInArrow(run, schema).groupBy(*keys).agg(*sums)


def _drawn(cells: DataFrame, n_words: int, n_classes: int, bags: int, seed: int) -> DataFrame:
    """Class counts of every cell drawn once per bag; a cell in the same place draws the same."""
    names = cells.columns[:n_words] + [f"s{i}" for i in range(n_classes * bags)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            random = np.random.default_rng([seed, *(batch.column(i)[0].as_py() for i in range(n_words))])
            counts = [batch.column(n_words + c).to_numpy(zero_copy_only=False) for c in range(n_classes)]
            sums = [pa.array(random.poisson(c).astype(float)) for _ in range(bags) for c in counts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_words], *sums], names)

    schema = ", ".join(f"{c} {'long' if c[0] == 'w' else 'double'}" for c in names)
    return cells.sortWithinPartitions(*cells.columns[:n_words]).mapInArrow(run, schema)


def _held(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells cached, and read in as many tasks as there is work."""
    cached = cells.persist(STORAGE)
    n = cached.count()
    return cached, cached.coalesce(max(1, -(-n // CELLS_PER_TASK)))


# -- growth -------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in order of creation; ``left`` is the left child, the right one follows, -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    depth: int = 0

    @staticmethod
    def stump(width: int) -> Tree:
        return Tree(np.array([-1]), np.array([0]), np.array([-1]), np.zeros((1, width)), np.zeros(1))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node of every column of ``bins`` (feature by row)."""
        at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(self.depth):
            feature = self.feature[at]
            inner = feature >= 0
            right = bins[np.maximum(feature, 0), rows] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)
        return at


#: (bins, sums) of a batch of cells -> for each tree grown, its sums (rows, then means to be) per cell
Stats = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]


def _histograms(
    cells: DataFrame, n_words: int, n_features: int, trees: list[Tree], active: list[np.ndarray], width: int, stats: Stats,
    n_tasks: int,
) -> list[np.ndarray]:
    """Sums by (node, feature, bin) of the active nodes of every tree, in one pass."""
    sizes = [len(a) * n_features * BINS * width for a in active]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            bins, sums = _bins(columns[:n_words], n_features), np.stack(columns[n_words:])
            out = []
            for tree, nodes, per_cell in zip(trees, active, stats(bins, sums)):
                number = np.full(len(tree.feature), -1)
                number[nodes] = np.arange(len(nodes))
                at = number[tree.leaves(bins)]
                here = at >= 0
                found = np.empty((len(nodes), n_features, BINS, width))
                for j in range(n_features):
                    key = at[here] * BINS + bins[j, here]
                    for s in range(width):
                        found[:, j, :, s] = np.bincount(
                            key, weights=per_cell[s][here], minlength=len(nodes) * BINS
                        ).reshape(-1, BINS)
                out.append(found.ravel())
            part = np.concatenate(out)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["state"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total = np.frombuffer(raw) if total is None else total + np.frombuffer(raw)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["state"])

    states = cells.mapInArrow(run, "state binary")
    if n_tasks > FAN_IN:
        states = _few(states).mapInArrow(added, "state binary")
    total = np.sum([np.frombuffer(bytes(r.state)) for r in states.collect()], axis=0)
    ends = np.cumsum([0, *sizes])
    return [total[a:b].reshape(-1, n_features, BINS, width) for a, b in zip(ends, ends[1:])]


def _best_splits(found: np.ndarray, classes: bool, min_n: float, allowed: np.ndarray):
    """Per node: gain, feature, bin, and the sums of node, left and right side.

    The gain in Gini or variance, times rows, is nl * nr / n * (distance of the means) ** 2.
    """
    left = np.cumsum(found, axis=2)
    whole = left[:, :1, -1:, :]
    right = whole - left
    rows = (lambda s: s.sum(axis=-1)) if classes else (lambda s: s[..., 0])
    sums = (lambda s: s) if classes else (lambda s: s[..., 1:])
    nl, nr, n = rows(left), rows(right), rows(whole)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = ((sums(left) / nl[..., None] - sums(right) / nr[..., None]) ** 2).sum(axis=-1)
        size = ((sums(whole) / n[..., None]) ** 2).sum(axis=-1)
        gain = nl * nr / n * apart
        usable = (nl >= max(min_n, 1)) & (nr >= max(min_n, 1)) & allowed[:, :, None] & (gain > 1e-20 * n * size)
    gain = np.where(usable, gain, 0.0).reshape(len(found), -1)
    best = gain.argmax(axis=1)
    feature, cut = np.divmod(best, BINS)
    i = np.arange(len(found))
    return gain[i, best], feature, cut, whole[:, 0, 0], left[i, feature, cut], right[i, feature, cut]


def grow(
    cells: DataFrame, n_features: int, n_trees: int, depth: int, min_n: float, classes: bool, width: int,
    stats: Stats, mtry: int | None = None, seed: int = 0,
) -> list[Tree]:
    """``n_trees`` trees side by side, level by level; ``stats`` gives the sums each learns from."""
    n_words = -(-n_features // DIGITS)
    random = np.random.default_rng(seed)
    n_tasks = cells.rdd.getNumPartitions()
    n_values = width if classes else 1
    trees = [Tree.stump(n_values) for _ in range(n_trees)]
    active = [np.array([0]) for _ in trees]

    def value(sums: np.ndarray) -> np.ndarray:
        total = sums.sum() if classes else sums[0]
        return (sums if classes else sums[1:]) / total if total else np.zeros(n_values)

    for level in range(max(depth, 1)):
        per_pass = max(1, STATE_CELLS // (n_features * BINS * width))
        todo = [(t, nodes[i : i + per_pass]) for t, nodes in enumerate(active) for i in range(0, len(nodes), per_pass)]
        active = [[] for _ in trees]
        before = list(trees)  # a tree that grows is a new one
        while todo:
            now, room = [], per_pass
            while todo and (not now or len(todo[0][1]) <= room):
                now.append(todo.pop(0))
                room -= len(now[-1][1])
            chosen = [t for t, _ in now]
            found = _histograms(
                cells, n_words, n_features, [before[t] for t in chosen], [nodes for _, nodes in now], width,
                _only(stats, chosen), n_tasks,
            )
            for (t, nodes), sums in zip(now, found):
                allowed = np.ones((len(nodes), n_features), bool)
                if mtry is not None and mtry < n_features:
                    allowed = random.random((len(nodes), n_features)).argsort(axis=1).argsort(axis=1) < mtry
                splits = _best_splits(sums, classes, min_n, allowed)
                tree, first = trees[t], len(trees[t].feature)
                rows, grown, new = [], 0, []
                for node, gain, feature, cut, whole, left, right in zip(nodes, *splits):
                    if node == 0:
                        tree.value[0] = value(whole)
                    if gain <= 0 or depth == 0:
                        continue
                    rows.append((node, feature, cut, first + grown, gain))
                    new += [value(left), value(right)]
                    active[t] += [first + grown, first + grown + 1]
                    grown += 2
                if rows:
                    trees[t] = _extended(tree, rows, np.array(new), level + 1)
        active = [np.array(nodes, int) for nodes in active]
        if not any(len(nodes) for nodes in active):
            break
    return trees


def _only(stats: Stats, chosen: list[int]) -> Stats:
    def some(bins: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
        found = stats(bins, sums)
        return [found[t] for t in chosen]

    return some


def _extended(tree: Tree, rows: list[tuple], new: np.ndarray, depth: int) -> Tree:
    pad = lambda a, x: np.concatenate([a, np.full(len(new), x, a.dtype)])
    out = Tree(
        pad(tree.feature, -1), pad(tree.cut, 0), pad(tree.left, -1), np.concatenate([tree.value, new]),
        pad(tree.gain, 0.0), depth,
    )
    for node, feature, cut, left, gain in rows:
        out.feature[node], out.cut[node], out.left[node], out.gain[node] = feature, cut, left, gain
    return out


# -- the model ----------------------------------------------------------------

FOREST_CLASSES, FOREST_MEAN, BOOST_SUM, BOOST_ODDS = range(4)


class GrownTrees(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Prediction and, for classes, probabilities of a forest or of boosted trees."""

    kind = Param(Params._dummy(), "kind", "how trees are put together", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "values of a leaf, or margins", TypeConverters.toInt)
    sizes = Param(Params._dummy(), "sizes", "nodes per tree", TypeConverters.toListInt)
    features = Param(Params._dummy(), "features", "by node, -1 at leaves", TypeConverters.toListInt)
    thresholds = Param(Params._dummy(), "thresholds", "by node: up to it goes left", TypeConverters.toListFloat)
    children = Param(Params._dummy(), "children", "left child by node", TypeConverters.toListInt)
    values = Param(Params._dummy(), "values", "by node", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "by tree", TypeConverters.toListFloat)
    importances = Param(Params._dummy(), "importances", "by feature", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self, *, kind=None, width=None, sizes=None, features=None, thresholds=None, children=None, values=None,
        weights=None, importances=None,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def _trees(self) -> tuple[list[np.ndarray], list[Tree]]:
        """Thresholds in use per feature, and the trees with bins between them."""
        get = self.getOrDefault
        feature, threshold = np.array(get(self.features), int), np.array(get(self.thresholds))
        cuts = [np.unique(threshold[feature == j]) for j in range(len(get(self.importances)))]
        cut = np.zeros(len(feature), int)
        for j, own in enumerate(cuts):
            cut[feature == j] = np.searchsorted(own, threshold[feature == j])
        left, ends = np.array(get(self.children), int), np.cumsum([0, *get(self.sizes)])
        values = np.array(get(self.values)).reshape(len(feature), -1)
        trees = []
        for a, b in zip(ends, ends[1:]):
            tree = Tree(feature[a:b], cut[a:b], left[a:b], values[a:b], np.zeros(b - a))
            depth = np.zeros(b - a, int)
            for i in np.flatnonzero(tree.feature >= 0):  # parents come before children
                depth[tree.left[i] : tree.left[i] + 2] = depth[i] + 1
            tree.depth = int(depth.max())
            trees.append(tree)
        return cuts, trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kind, width = self.getOrDefault(self.kind), self.getOrDefault(self.width)
        weights = self.getOrDefault(self.weights)
        cuts, trees = self._trees()
        radix = [len(c) + 1 for c in cuts]
        n_codes = float(np.prod([float(r) for r in radix]))

        def scores(bins: np.ndarray) -> np.ndarray:
            out = np.zeros((bins.shape[1], width))
            for t, (tree, weight) in enumerate(zip(trees, weights)):
                part = tree.value[tree.leaves(bins)] * weight
                if kind == BOOST_ODDS:
                    out[:, t % width] += part[:, 0]
                else:
                    out += part
            return out

        @F.arrow_udf("array<double>")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = table = None
            if n_codes <= TABLE_CELLS:  # rows with equal bins have equal scores: each is found once
                known, table = np.zeros(int(n_codes), bool), np.zeros((int(n_codes), width))
            for batch in batches:
                if len(batch) == 0:
                    yield pa.array([], pa.list_(pa.float64()))
                    continue
                x = _matrix(batch)
                bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)])
                if table is None:
                    found = scores(bins)
                else:
                    code = np.zeros(len(x), np.int64)
                    for j, r in enumerate(radix):
                        code = code * r + bins[j]
                    fresh, first = np.unique(code[~known[code]], return_index=True)
                    if len(fresh):
                        table[fresh] = scores(bins[:, np.flatnonzero(~known[code])[first]])
                        known[fresh] = True
                    found = table[code]
                ends = np.arange(len(batch) + 1, dtype=np.int32) * width
                yield pa.ListArray.from_arrays(ends, found.ravel())

        out = dataset.withColumn("_scores", score(vector_to_array("features")))
        margin = F.col("_scores")
        if kind in (FOREST_MEAN, BOOST_SUM):
            return out.withColumn("prediction", margin[0]).drop("_scores")
        if kind == FOREST_CLASSES:
            chances = margin
        elif width == 1:
            chance = 1 / (1 + F.exp(-2 * margin[0]))
            chances = F.array(1 - chance, chance)
        else:
            odds = F.transform(margin, lambda m: 1 / (1 + F.exp(-2 * m)))
            chances = F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))
        # the first of the largest; two classes meet at a margin of zero
        ranked = F.array(-margin[0], margin[0]) if kind == BOOST_ODDS and width == 1 else margin
        place = F.array_position(ranked, F.array_max(ranked)) - 1
        return out.withColumns({"prediction": place.cast("double"), "probability": chances}).drop("_scores")


def _model(
    trees: list[Tree], cuts: list[np.ndarray], kind: int, width: int, weights: list[float], normalise: bool
) -> PipelineModel:
    importances = np.zeros(len(cuts))
    for tree in trees:
        own = np.zeros(len(cuts))
        np.add.at(own, np.maximum(tree.feature, 0), tree.gain)
        importances += own / own.sum() if normalise and own.sum() else own
    joined = lambda name: np.concatenate([getattr(t, name) for t in trees])
    thresholds = [
        float(cuts[j][c]) if j >= 0 else 0.0 for j, c in zip(joined("feature"), joined("cut"))
    ]
    return PipelineModel([
        GrownTrees(
            kind=kind, width=width, sizes=[len(t.feature) for t in trees], features=joined("feature").tolist(),
            thresholds=thresholds, children=joined("left").tolist(), values=joined("value").ravel().tolist(),
            weights=weights, importances=(importances / (importances.sum() or 1.0)).tolist(),
        )
    ])


def _rows(features: DataFrame) -> DataFrame:
    return features.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))


class GrownForest:
    """Bagged trees; each node may split on a share of the features."""

    def __init__(
        self, task_type: str, n_classes: int, mtry_share: float, min_n: int, trees: int, depth: int, seed: int
    ) -> None:
        self.n_classes = 0 if task_type == REGRESSION else n_classes
        self.mtry_share, self.min_n, self.trees, self.depth, self.seed = mtry_share, min_n, trees, depth, seed

    def fit(self, features: DataFrame) -> PipelineModel:
        rows, grown, classes = _rows(features), [], self.n_classes
        cuts = find_cuts(rows, FOREST_BINS)
        n_words, width = -(-len(cuts) // DIGITS), classes or 2
        mtry = max(1, int(np.ceil(self.mtry_share * len(cuts))))
        for first in range(0, self.trees, BAG_TREES):
            bags = min(BAG_TREES, self.trees - first)
            cells = cells_of(rows, cuts, classes, 0 if classes else bags, self.seed + first)
            if classes:
                cells = _drawn(cells, n_words, classes, bags, self.seed + first)
            cached, cells = _held(cells)
            try:
                grown += grow(
                    cells, len(cuts), bags, self.depth, self.min_n, bool(classes), width,
                    lambda bins, sums, bags=bags: list(sums.reshape(bags, width, -1)), mtry, self.seed + first,
                )
            finally:
                cached.unpersist()
        kind = FOREST_CLASSES if classes else FOREST_MEAN
        return _model(grown, cuts, kind, classes or 1, [1 / len(grown)] * len(grown), True)


class GrownBoost:
    """Boosted trees: squared error, or log loss of one class (two classes) or of each against the rest."""

    def __init__(
        self, task_type: str, n_classes: int, learn_rate: float, min_n: int, trees: int, depth: int
    ) -> None:
        self.n_classes = 0 if task_type == REGRESSION else n_classes
        self.learn_rate, self.min_n, self.trees, self.depth = learn_rate, min_n, trees, depth

    def fit(self, features: DataFrame) -> PipelineModel:
        rows, classes = _rows(features), self.n_classes
        cuts = find_cuts(rows)
        n_words, n = -(-len(cuts) // DIGITS), len(cuts)
        positive = [1] if classes == 2 else list(range(classes))
        margins = len(positive) or 1
        n_sums = classes or 2
        cached, cells = _held(cells_of(rows, cuts, classes))
        grown: list[Tree] = []
        weights: list[float] = []
        try:
            for done in range(self.trees):
                if done and done % REFRESH == 0:
                    older = cached
                    fresh = grown[-REFRESH * margins :]
                    cached, cells = _held(self._with_margins(cells, n_words, n, n_sums, margins, fresh, weights[-len(fresh) :]))
                    older.unpersist()
                since = done - done % REFRESH
                recent, own = grown[since * margins :], weights[since * margins :]

                def stats(bins, sums, recent=recent, own=own, first=not done, kept=since > 0):
                    at = _margins(bins, recent, own, margins) + (sums[n_sums:] if kept else 0)
                    out = []
                    for k in range(margins):
                        if not classes:
                            total, count = sums[1], sums[0]
                            out.append([count, total if first else 2 * (total - count * at[0])])
                            continue
                        yes = sums[positive[k]]
                        count = sums[:classes].sum(axis=0)
                        up, down = np.ones_like(at[k]), -np.ones_like(at[k])
                        if not first:
                            with np.errstate(over="ignore"):
                                up, down = 4 / (1 + np.exp(2 * at[k])), -4 / (1 + np.exp(-2 * at[k]))
                        out.append([count, yes * up + (count - yes) * down])
                    return out

                new = grow(cells, n, margins, self.depth, self.min_n, False, 2, stats)
                grown += new
                weights += [self.learn_rate if done else 1.0] * margins
        finally:
            cached.unpersist()
        kind = BOOST_ODDS if classes else BOOST_SUM
        return _model(grown, cuts, kind, margins, weights, False)

    @staticmethod
    def _with_margins(cells, n_words, n_features, n_sums, margins, trees, weights) -> DataFrame:
        """The cells with what the trees so far say of them."""
        names = cells.columns[: n_words + n_sums] + [f"m{i}" for i in range(margins)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                at = _margins(_bins(columns[:n_words], n_features), trees, weights, margins)
                before = columns[n_words + n_sums :]
                sums = [m + before[i] if before else m for i, m in enumerate(at)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: n_words + n_sums], *map(pa.array, sums)], names
                )

        return cells.mapInArrow(run, ", ".join(f"{c} {'long' if c[0] == 'w' else 'double'}" for c in names))


def _margins(bins: np.ndarray, trees: list[Tree], weights: list[float], margins: int) -> np.ndarray:
    out = np.zeros((margins, bins.shape[1]))
    for t, (tree, weight) in enumerate(zip(trees, weights)):
        out[t % margins] += weight * tree.value[tree.leaves(bins), 0]
    return out
