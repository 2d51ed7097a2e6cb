"""Learners by engine name, all distributed Spark ML estimators or built from them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlscout.operators.recommend import is_compatible
from mlscout.operators.task import CLASSIFICATION, REGRESSION
from mlscout.plans.grown import GrownBoost, GrownForest
from mlscout.plans.hinge import FourierHinge
from mlscout.plans.huber import FourierHuber, array_rows, fourier_map, fourier_weights
from mlscout.plans.pruning import pruned_trees

SEED = 123
# Forest size, boosting rounds and boosting leaf size.
FOREST_TREES = 300
BOOST_ROUNDS = 100
BOOST_MIN_ROWS = 5

TREE_ENGINES = ["ranger", "xgboost", "rpart"]

# Tuning ranges, from coarse to fine in this order of importance. ``tune`` takes the
# first g combinations of a fixed low-discrepancy walk through them.
GRIDS: dict[str, dict[str, tuple[float, float, str]]] = {
    "glmnet": {"penalty": (1e-4, 1.0, "log")},
    "ranger": {"mtry_share": (0.2, 1.0, "linear"), "min_n": (2, 40, "int")},
    "xgboost": {"learn_rate": (0.003, 0.3, "log"), "depth": (2, 8, "int")},
    "kernlab": {"cost": (2.0**-5, 2.0**5, "log")},
    "kknn": {"k": (1, 15, "int")},
    "rpart": {"cp": (1e-5, 1e-1, "log"), "depth": (2, 10, "int")},
}

DEFAULTS: dict[str, dict[str, Any]] = {
    "glmnet": {"penalty": 0.01, "mixture": 1.0},
    "ranger": {"mtry_share": 0.5, "min_n": 5, "trees": FOREST_TREES, "depth": 12},
    "xgboost": {"learn_rate": 0.1, "depth": 5, "trees": BOOST_ROUNDS, "min_n": BOOST_MIN_ROWS},
    "kernlab": {"cost": 1.0, "sigma": None, "n_features": 256},
    "kknn": {"k": 5, "weights": "optimal"},
    "rpart": {"cp": 0.01, "depth": 10},
}


def has_tunables(engine: str) -> bool:
    return engine in GRIDS


def tuning_grid(engine: str, size: int) -> list[dict[str, Any]]:
    """``size`` settings spread over the engine's ranges; the same for every run."""
    ranges = GRIDS[engine]
    settings: list[dict[str, Any]] = []
    for i in range(size):
        setting: dict[str, Any] = {}
        for axis, (name, (low, high, scale)) in enumerate(ranges.items()):
            # evenly spaced on the first axis, a golden-ratio walk on the others
            share = (i + 0.5) / size if axis == 0 else (0.5 + i * 0.6180339887498949) % 1.0
            if scale == "log":
                setting[name] = math.exp(math.log(low) + share * (math.log(high) - math.log(low)))
            elif scale == "int":
                setting[name] = min(int(high), int(low + share * (high - low + 1)))
            else:
                setting[name] = low + share * (high - low)
        if setting not in settings:
            settings.append(setting)
    return settings


class RandomFourierFeatures(
    Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """Random Fourier map of a Gaussian kernel (Rahimi and Recht 2007).

    Linear learners on the mapped vector approximate kernel machines and train in
    passes over the data instead of over pairs of rows.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "mapped dimensions", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, gamma=1.0, size=256, seed=SEED):
        super().__init__()
        self._setDefault(gamma=1.0, size=256, seed=SEED)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, size = self.getOrDefault("gamma"), self.getOrDefault("size")
        seed = self.getSeed()

        # flat Arrow buffers both ways: a Python object per row would cost more than the map
        @F.arrow_udf("array<double>")
        def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import numpy as np
            import pyarrow as pa

            made = None
            for batch in batches:
                if len(batch) == 0:
                    yield pa.array([], pa.list_(pa.float64()))
                    continue
                rows = array_rows(batch)
                made = made or fourier_weights(rows.shape[1], gamma, size, seed)
                ends = np.arange(len(batch) + 1, dtype=np.int32) * size
                yield pa.ListArray.from_arrays(ends, fourier_map(rows, *made).ravel())

        mapped = array_to_vector(project(vector_to_array(F.col(self.getInputCol()))))
        return dataset.withColumn(self.getOutputCol(), mapped)


def lasso_regression(penalty: float, mixture: float = 1.0) -> Estimator:
    return LinearRegression(
        regParam=penalty, elasticNetParam=mixture, standardization=False, maxIter=100
    )


def lasso_multinomial(penalty: float, mixture: float = 1.0) -> Estimator:
    return LogisticRegression(
        family="multinomial", regParam=penalty, elasticNetParam=mixture,
        standardization=False, maxIter=100, tol=1e-5,
    )


def random_forest(
    task_type: str,
    mtry_share: float,
    min_n: int,
    trees: int = FOREST_TREES,
    depth: int = 12,
    n_classes: int = 2,
) -> GrownForest:
    return GrownForest(task_type, n_classes, float(mtry_share), int(min_n), int(trees), int(depth), SEED)


def boosted_trees(
    task_type: str,
    learn_rate: float,
    depth: int,
    trees: int = BOOST_ROUNDS,
    min_n: int = BOOST_MIN_ROWS,
    n_classes: int = 2,
) -> GrownBoost:
    return GrownBoost(task_type, n_classes, learn_rate, int(min_n), int(trees), int(depth))


def svm_rbf(
    task_type: str,
    cost: float,
    sigma: float | None,
    n_features: int,
    *,
    n_rows: int,
    n_inputs: int,
    n_classes: int = 2,
) -> FourierHinge | FourierHuber:
    """Kernel machine by random Fourier features: hinge loss, or Huber loss for regression.

    ``cost`` weighs the summed loss against the margin, as in the kernel form. Class
    probabilities come from a logistic fit on the margins (Platt scaling).
    """
    gamma = float(sigma if sigma is not None else 1.0 / max(n_inputs, 1))
    weight = 1.0 / (cost * max(n_rows, 1))
    if task_type == REGRESSION:
        return FourierHuber(gamma, n_features, SEED, weight)
    return FourierHinge(gamma, n_features, SEED, weight, n_classes)


class PrunedTree:
    """A decision tree cut back by its complexity; ``fit_all`` grows one tree for all settings."""

    def __init__(self, task_type: str, params: dict[str, Any], n_inputs: int) -> None:
        self.task_type, self.params, self.n_inputs = task_type, params, n_inputs

    def fit(self, features: DataFrame) -> PipelineModel:
        return self.fit_all(features, [self.params])[0]

    def fit_all(self, features: DataFrame, settings: Sequence[dict[str, Any]]) -> list[PipelineModel]:
        return pruned_trees(features, self.task_type, settings, self.n_inputs)


def plain_linear(task_type: str) -> Estimator:
    if task_type == REGRESSION:
        return LinearRegression(regParam=0.0, standardization=False, maxIter=100)
    return LogisticRegression(regParam=0.0, standardization=False, maxIter=100)


def make_estimator(
    engine: str,
    task_type: str,
    params: dict[str, Any] | None = None,
    *,
    n_classes: int = 2,
    n_inputs: int = 1,
    n_rows: int = 1,
) -> Estimator:
    """The learner of an engine; unknown engines get the plain linear one."""
    check_engine(engine, task_type)
    p = DEFAULTS.get(engine, {}) | (params or {})
    if engine == "glmnet":
        maker = lasso_regression if task_type == REGRESSION else lasso_multinomial
        return maker(p["penalty"], p["mixture"])
    if engine == "ranger":
        return random_forest(
            task_type, p["mtry_share"], p["min_n"], p["trees"], p["depth"], n_classes
        )
    if engine == "xgboost":
        return boosted_trees(
            task_type, p["learn_rate"], p["depth"], p["trees"], p["min_n"], n_classes
        )
    if engine == "kernlab":
        return svm_rbf(
            task_type, p["cost"], p["sigma"], p["n_features"],
            n_rows=n_rows, n_inputs=n_inputs, n_classes=n_classes,
        )
    if engine == "kknn":
        from mlscout.plans.knn import NeighbourVote

        return NeighbourVote(task_type, int(p["k"]), n_classes, p["weights"])
    if engine == "rpart":
        return PrunedTree(task_type, p, n_inputs)
    if engine == "naivebayes":
        return NaiveBayes(modelType="gaussian")
    return plain_linear(task_type)


def check_engine(engine: str, task_type: str) -> None:
    if is_compatible(engine, task_type):
        return
    if engine == "naivebayes":
        raise ValueError(
            "naive Bayes learns classes only; for regression take glmnet, ranger or xgboost"
        )
    raise ValueError(f"engine '{engine}' cannot learn a {task_type} task")


def class_probability(scored: DataFrame, engine: str, n_classes: int) -> Column:
    """Class probabilities as an array in level order, whatever the learner offers."""
    if "probability" in scored.columns:
        dtype = scored.schema["probability"].dataType.typeName()
        ref = F.col("probability")
        return ref if dtype == "array" else vector_to_array(ref)
    # one-vs-rest boosting: one margin per class, logistic in twice the margin
    odds = F.transform(
        vector_to_array(F.col("rawPrediction")), lambda m: 1 / (1 + F.exp(-2 * m))
    )
    total = F.aggregate(odds, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(odds, lambda x: x / total)


__all__ = [
    "CLASSIFICATION", "DEFAULTS", "GRIDS", "RandomFourierFeatures", "TREE_ENGINES",
    "PrunedTree", "boosted_trees", "check_engine", "class_probability", "has_tunables",
    "lasso_multinomial", "lasso_regression", "make_estimator", "plain_linear", "random_forest",
    "svm_rbf", "tuning_grid",
]
