"""Machines with hinge loss that map their rows again in every pass."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors

from mlscout.plans import hinge
from mlscout.plans.estimators import RandomFourierFeatures, make_estimator
from mlscout.plans.huber import fourier_map, fourier_weights

SIZE, GAMMA, N = 8, 0.5, 900


def rows(spark, classes):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(N, 2))
    label = np.digitize(x[:, 0] + x[:, 1] ** 2 + rng.normal(0, 0.4, N), [0.6, 1.8][: classes - 1])
    pairs = [(Vectors.dense(a), float(b)) for a, b in zip(x.tolist(), label)]
    table = spark.createDataFrame(pairs, ["features", "label"])
    return x, label, table.repartition(3).cache()


def loss(x, label, one, slopes, intercept, penalty):
    """Mean hinge loss and penalty, without any rounding."""
    mapped = fourier_map(x, *fourier_weights(2, GAMMA, SIZE, 123))
    y = np.where(label == one, 1.0, -1.0)
    spread = mapped.var(axis=0, ddof=1)
    return np.maximum(1 - y * (mapped @ slopes + intercept), 0).mean() + 0.5 * penalty * spread @ slopes**2


@pytest.mark.parametrize("classes", [2, 3])
def test_the_hinge_is_at_least_as_small_as_sparks_and_no_mapped_row_is_stored(spark, classes, monkeypatch):
    x, label, table = rows(spark, classes)
    machine = make_estimator(
        "kernlab", "classification", {"n_features": SIZE, "cost": 0.05, "sigma": GAMMA},
        n_rows=N, n_inputs=2, n_classes=classes,
    )
    # Spark's own machine caches the rows that it is given: mapped ones, and once more for each class
    monkeypatch.setattr(RandomFourierFeatures, "_transform", None)
    model = machine.fit(table)
    monkeypatch.undo()
    fitted = model.stages[0]
    intercepts = fitted.getOrDefault("intercepts")
    slopes = np.array(fitted.getOrDefault("slopes")).reshape(-1, SIZE)
    assert len(intercepts) == (1 if classes == 2 else classes)
    penalty = 1 / (0.05 * N)
    mapped = RandomFourierFeatures(inputCol="features", outputCol="fourier", gamma=GAMMA, size=SIZE, seed=123).transform(table)
    for one, own, intercept in zip([1] if classes == 2 else range(classes), slopes, intercepts):
        target = mapped.selectExpr("fourier", f"double(label = {one}) AS label")
        theirs = LinearSVC(featuresCol="fourier", regParam=penalty, maxIter=50).fit(target)
        best = loss(x, label, one, theirs.coefficients.toArray(), theirs.intercept, penalty)
        assert loss(x, label, one, own, intercept, penalty) <= best + hinge.ROUNDED / 4


@pytest.mark.parametrize("classes", [2, 3])
def test_margins_predictions_and_chances(spark, classes, tmp_path):
    x, label, table = rows(spark, classes)
    model = make_estimator(
        "kernlab", "classification", {"n_features": SIZE, "sigma": GAMMA}, n_rows=N, n_inputs=2, n_classes=classes
    ).fit(table)
    found = model.transform(table).collect()
    mapped = fourier_map(np.array([r.features.toArray() for r in found]), *fourier_weights(2, GAMMA, SIZE, 123))
    slopes = np.array(model.stages[0].getOrDefault("slopes")).reshape(-1, SIZE)
    margins = mapped @ slopes.T + model.stages[0].getOrDefault("intercepts")
    if classes == 2:
        margins = np.hstack([-margins, margins])
    assert np.allclose([r.margin.toArray() for r in found], margins)
    assert [r.prediction for r in found] == margins.argmax(axis=1).tolist()
    assert np.allclose([r.probability.toArray().sum() for r in found], 1.0)
    assert np.mean([r.prediction == r.label for r in found]) > 0.75
    model.write().overwrite().save(str(tmp_path / "machine"))
    again = PipelineModel.load(str(tmp_path / "machine")).transform(table).collect()
    assert [r.probability for r in again] == [r.probability for r in found]


def test_classes_are_solved_in_turn_where_their_sums_are_large(spark, monkeypatch):
    _, _, table = rows(spark, 3)
    fit = lambda: hinge.FourierHinge(GAMMA, SIZE, 123, 0.01, 3).fit(table).stages[0].getOrDefault("slopes")
    whole = fit()
    monkeypatch.setattr(hinge, "STATE_CELLS", 1)
    assert np.allclose(fit(), whole, rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("share", [0.0, 0.02, 0.3])
def test_without_a_signal_all_rows_get_the_larger_class(share):
    rng = np.random.default_rng(3)
    n = 5_000
    block = np.hstack([fourier_map(rng.normal(size=(n, 3)), *fourier_weights(3, 0.3, 16, 1)), np.ones((n, 1))])
    y = np.where(rng.random(n) < share, 1.0, -1.0)[:, None]
    path = hinge.HingePath(np.append(np.zeros(16), -1.0), np.append(np.full(16, 1e-4), 0.0))
    for _ in range(hinge.STEPS):
        if path.done:
            break
        total = hinge._empty(1, 17)
        hinge.add_block(total, block, y, path.at[None], path.step[None], [path.h])
        path.told(n, *(total[k][0] for k in ("losses", "gradient", "curvature", "drift")))
    assert path.done
    # all on the side of the larger class lose 2 for each row of the other
    assert np.maximum(1 - y[:, 0] * (block @ path.at), 0).mean() <= 2 * np.mean(y > 0) + 1e-3
    assert (block @ path.at < 0).mean() > 0.99


def test_rows_that_are_not_finite_are_refused(spark):
    table = spark.createDataFrame([(Vectors.dense([float("nan"), 1.0]), 1.0), (Vectors.dense([0.0, 1.0]), 0.0)], ["features", "label"])
    with pytest.raises(ValueError, match="finite"):
        hinge.FourierHinge(GAMMA, SIZE, 123, 0.01, 2).fit(table)
