"""Nested subtrees against all subtrees of small trees, and trees cut back against trees grown small."""

import itertools
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from mlscout.plans.pruning import Node, deep_tree, pruned, pruned_trees, read_tree, weakest_links


def grown(seed, depth):
    """A tree with random risks, each split saving something."""
    rng, nodes = random.Random(seed), []

    def visit(level, parent, risk):
        at = len(nodes)
        nodes.append(Node(level, parent, 0.0, [], risk))
        if level < depth and rng.random() < 0.85:
            left = risk * rng.random() * 0.6
            right = (risk - left) * rng.random()
            nodes[at].children = [visit(level + 1, at, left), visit(level + 1, at, right)]
        return at

    visit(0, None, 100.0)
    return nodes


def subtrees(nodes, i=0):
    """(risk, leaves, splitting nodes) of every subtree with the same root."""
    yield nodes[i].risk, 1, frozenset()
    if nodes[i].children:
        for a, b in itertools.product(*[list(subtrees(nodes, c)) for c in nodes[i].children]):
            yield a[0] + b[0], a[1] + b[1], a[2] | b[2] | {i}


@pytest.mark.parametrize("seed", range(12))
def test_every_complexity_gets_its_best_subtree(seed):
    nodes = grown(seed, 3)
    every = list(subtrees(nodes))
    for cp in [0.0, 1e-4, 0.003, 0.01, 0.03, 0.1, 0.2, 0.5, 1.0]:
        best = min(every, key=lambda t: (round(t[0] + cp * nodes[0].risk * t[1], 9), t[1]))
        splits = pruned(nodes, cp)
        assert {i for i, s in enumerate(splits) if s} == best[2]
    links = weakest_links(nodes)
    assert [x[2] for x in links] == sorted((x[2] for x in links), reverse=True)
    assert [x[0] for x in links] == sorted(x[0] for x in links) and links[-1][2] == 1


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3)).round(1)
    y = np.where(x[:, 0] > 0, 5.0, 0.0) + np.where(x[:, 1] > 0.5, 2.0, 0.0) + rng.normal(scale=0.5, size=600)
    rows = [(*map(float, x[i]), float(y[i]), float(y[i] > 3) + float(y[i] > 6)) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, k double").repartition(2)
    return df.select(array_to_vector(F.array("a", "b", "c")).alias("features"), "y", "k").cache()


def test_smaller_depth_is_a_subtree(features):
    learn = features.select("features", F.col("y").alias("label"))
    for depth, model in zip((1, 3, 5), pruned_trees(learn, "regression", [{"cp": 0.0, "depth": d} for d in (1, 3, 5)], 3)):
        own = model.transform(learn).groupBy("prediction").count().collect()
        alone = DecisionTreeRegressor(maxDepth=depth, seed=123).fit(learn).transform(learn).groupBy("prediction").count()
        assert np.allclose(sorted(map(tuple, own)), sorted(map(tuple, alone.collect())))


def test_pruned_classes(features, tmp_path):
    learn = features.select("features", F.col("k").alias("label"))
    nodes = read_tree(deep_tree("classification", 6).fit(learn), "classification")
    found = pruned_trees(learn, "classification", [{"cp": 0.0, "depth": 6}, {"cp": 0.05, "depth": 6}, {"cp": 1.0, "depth": 6}], 3)
    wrong = []
    for model in found:
        rows = model.transform(learn).select("label", "prediction", "probability").collect()
        assert all(sum(r["probability"]) == pytest.approx(1.0) for r in rows)
        wrong.append(sum(r["label"] != r["prediction"] for r in rows))
    assert wrong[0] <= wrong[1] <= wrong[2] == nodes[0].risk
    last = found[1].stages[-1]
    importances = last.getOrDefault(last.importances)
    assert sum(importances) == pytest.approx(1.0) and importances[2] == min(importances)
    found[1].write().overwrite().save(str(tmp_path / "m"))
    back = type(found[1]).load(str(tmp_path / "m"))
    assert back.transform(learn).exceptAll(found[1].transform(learn)).count() == 0
