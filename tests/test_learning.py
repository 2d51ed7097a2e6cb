from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mlscout.operators.neighbours import KERNELS, kernel_weight, nearest_neighbours, weighted_neighbours
from mlscout.plans.estimators import GRIDS, RandomFourierFeatures, make_estimator, tuning_grid
from mlscout.operators.bayes import gaussian_nb, gaussian_nb_predict
from mlscout.plans.findings import explain, importance_findings, next_steps, write_report
from mlscout.plans.knn import NeighbourVote
from mlscout.plans.train import _features, compare, importance, load_model, permutation_importance, save_model, train
from mlscout.operators.recipe import Recipe
from mlscout.plans.validate import validate
from mlscout.sources.sinks import write_predictions


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(scale=0.1, size=400)
    rows = [
        (i, *map(float, x[i]), "ab"[i % 2], float(y[i]), "high" if y[i] > 1 else "low" if y[i] < -1 else "mid")
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "id int, x1 double, x2 double, noise double, c string, y double, k string")
    return df.repartition(2).cache()


def _estimates(result):
    return {r.metric: r.estimate for r in result.test_metrics.collect()}


def test_lasso_finds_the_signal_and_round_trips(spark, planted, tmp_path):
    result = train(planted.drop("k"), "y", "glmnet", "regression", cv_folds=2, tune_grid=2, key="id")
    assert _estimates(result)["rsq"] > 0.95
    names = [r.variable for r in result.importance.collect()]
    assert names[:2] == ["x1", "x2"]
    assert {r.metric for r in result.cv_metrics.collect()} == {"rmse", "rsq", "mae"}
    sections = {r.section for r in explain(result).collect()}
    assert {"summary", "metrics", "importance", "baseline", "overfitting", "assumptions"} <= sections
    again = train(planted.drop("k"), "y", "glmnet", "regression", cv_folds=2, tune_grid=2, key="id")
    assert _estimates(again) == pytest.approx(_estimates(result))
    save_model(result.model, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    a = {r.id: r.prediction for r in result.model.predict(result.test_data, ["id"]).collect()}
    b = {r.id: r.prediction for r in back.predict(result.test_data, ["id"]).collect()}
    assert a == pytest.approx(b)
    checked = validate(result, planted.drop("k").withColumn("extra", F.lit(1)))
    assert checked.drift.first().verdict == "consistent"
    with pytest.raises(ValueError, match="lacks"):
        validate(result, planted.drop("x1"))
    write_report(result, str(tmp_path / "report"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert text.startswith("<html>") and "rsq" in text
    result.release()
    again.release()


def test_tree_classes_with_unseen_levels(spark, planted, tmp_path):
    result = train(planted.drop("y"), "k", "rpart", "classification", cv_folds=2, tune_grid=2, key="id")
    found = _estimates(result)
    assert found["accuracy"] > 0.7 and 0.5 < found["roc_auc"] <= 1
    assert result.stratified and result.cv_stratified
    new = planted.drop("y").withColumn("c", F.lit("fresh")).withColumn(
        "k", F.when(F.col("id") < 50, "unheard").otherwise(F.col("k"))
    )
    checked = validate(result, new)
    assert checked.predictions.filter("k IS NULL").count() == 50
    assert {"accuracy", "kappa"} <= {r.metric for r in checked.metrics.collect()}
    ranked = permutation_importance(result.model, result.test_data, "id", bucket_rows=40).collect()
    assert {r.variable for r in ranked[:2]} == {"x1", "x2"}
    write_predictions(result.predictions, str(tmp_path / "p"), result.model.levels)
    back = spark.read.csv(str(tmp_path / "p"), header=True)
    assert {"pred_high", "pred_low", "pred_mid", "prediction", "k", "id"} == set(back.columns)
    result.release()


@pytest.mark.parametrize("engine, params", [("naivebayes", {}), ("kernlab", {"n_features": 32}), ("kknn", {})])
def test_other_class_learners_beat_the_baseline(planted, engine, params):
    result = train(
        planted.drop("y"), "k", engine, "classification", cv_folds=2, tune_grid=1, key="id", params=params
    )
    assert _estimates(result)["accuracy"] > 0.6
    sums = result.predictions.select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert sums.filter("abs(s - 1) > 1e-6").isEmpty()
    result.release()


def test_multiclass_boosting_has_probabilities(planted):
    result = train(
        planted.drop("y"), "k", "xgboost", "classification", cv_folds=2, tune_grid=1, key="id",
        params={"trees": 3, "depth": 2},
    )
    assert _estimates(result)["roc_auc"] > 0.6 and result.importance is not None
    result.release()


def test_comparison_skips_failures(planted):
    steps = []
    with pytest.warns(UserWarning, match="failed"):
        found = compare(
            planted.drop("k"), "y", "regression", ["lm", "naivebayes", "rpart"], cv_folds=2, tune_grid=1,
            key="id", progress=lambda share, text: steps.append(share),
        )
    assert set(found.models) == {"lm", "rpart"} and found.best_model == "lm"
    assert steps == pytest.approx([1 / 3, 2 / 3, 1])
    assert [r.model for r in found.table.collect()] == ["lm", "rpart"]
    suggested = [r.suggested for r in next_steps(found.models["rpart"].test_metrics, "ranger", "regression").collect()]
    assert "ranger" not in suggested
    found.release()


def test_common_column_names_do_not_collide(planted):
    names = {"k": "label", "x1": "features", "x2": "fold", "c": "n", "noise": "metric"}
    df = planted.drop("y").withColumnsRenamed(names)
    result = train(df, "label", "rpart", "classification", cv_folds=2, tune_grid=1, key="id")
    assert _estimates(result)["accuracy"] > 0.6
    assert result.predictions.columns == ["id", "label", "prediction", "probability"]
    assert {"features", "fold"} <= {r.variable for r in result.importance.collect()}
    assert validate(result, df).metrics.count() > 3
    result.release()
    with pytest.raises(ValueError, match="rename"):
        train(df.withColumnRenamed("label", "prediction"), "prediction", "rpart", "classification")


def test_wrong_engine_is_refused(planted):
    with pytest.raises(ValueError, match="naive Bayes"):
        train(planted, "y", "naivebayes", "regression")
    with pytest.raises(ValueError, match="cannot learn"):
        make_estimator("lm", "classification")
    with pytest.raises(ValueError, match="not found"):
        train(planted, "nope", "lm", "regression")


def test_grids_have_distinct_settings():
    for engine in GRIDS:
        grid = tuning_grid(engine, 10)
        assert len({str(g) for g in grid}) == len(grid) >= 9


def _brute(train_rows, test_points, k):
    out = {}
    for p in test_points:
        order = sorted((float(np.sqrt(((np.array(q) - np.array(p)) ** 2).sum())), key) for key, q in train_rows)
        out[tuple(p)] = [key for _, key in order[:k]]
    return out


@pytest.mark.parametrize("options", [{}, {"points_per_pivot": 20, "block_rows": 7}])
def test_neighbours_against_brute_force(spark, options):
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(150, 3)), 1)
    points[:50] = points[0]  # a third of the rows are copies
    rows = [(i, points[i].tolist()) for i in range(150)]
    train_df = spark.createDataFrame(rows, "key int, point array<double>")
    test_df = train_df.select("point").limit(150)
    found = {}
    for r in nearest_neighbours(train_df, test_df, 4, **options).orderBy("rank").collect():
        found.setdefault(tuple(r.point), []).append(r.key)
    assert found == _brute(rows, [p for _, p in rows], 4)


def test_kernel_weights_by_hand(spark):
    by_hand = {
        "rectangular": lambda u, j: 1.0, "triangular": lambda u, j: 1 - u,
        "epanechnikov": lambda u, j: 0.75 * (1 - u**2), "biweight": lambda u, j: 15 / 16 * (1 - u**2) ** 2,
        "triweight": lambda u, j: 35 / 32 * (1 - u**2) ** 3, "cos": lambda u, j: np.pi / 4 * np.cos(u * np.pi / 2),
        "inv": lambda u, j: 1 / u, "rank": lambda u, j: 4.0 - j,
        "gaussian": lambda u, j: np.exp(-((1.1503493803760079 * u) ** 2) / 2) / np.sqrt(2 * np.pi),
        "optimal": lambda u, j: (2 - (j**2 - (j - 1) ** 2) / 3) / 3,  # two dimensions
    }
    train_df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(9)], "key int, point array<double>")
    test_df = spark.createDataFrame([([-1.0, 0.0],)], "point array<double>")
    found = nearest_neighbours(train_df, test_df, 4)  # neighbour 4 lies at distance 4
    weighted = found.select("rank", "key", *[kernel_weight(3, x).alias(f"by_{x}") for x in KERNELS])
    rows = weighted.filter("rank <= 3").orderBy("rank").collect()
    assert [r.key for r in rows] == [0, 1, 2] and set(by_hand) == set(KERNELS)
    for j, r in enumerate(rows, 1):
        for kernel, weight in by_hand.items():
            assert r[f"by_{kernel}"] == pytest.approx(weight(j / 4, j), rel=1e-9)


@pytest.mark.parametrize("k", [1, 4, 9])  # fewer and more than there are
def test_kernel_weights_stay_above_zero(spark, k):
    rows = [(i, [0.0, 0.0]) for i in range(5)]  # all distances are 0, or all are equal
    train_df = spark.createDataFrame(rows, "key int, point array<double>")
    test_df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "point array<double>")
    found = weighted_neighbours(train_df, test_df, k).select("*", *[kernel_weight(k, x).alias(f"by_{x}") for x in KERNELS])
    rows = found.collect()
    assert len(rows) == 2 * min(k, 5)
    assert all(r[f"by_{x}"] > 0 and np.isfinite(r[f"by_{x}"]) for r in rows for x in KERNELS)
    with pytest.raises(ValueError, match="no kernel"):
        kernel_weight(2, "square")


def test_near_rows_outvote_far_ones(spark):
    rows = [(0.0, 0.0), (0.2, 0.0), (5.0, 1.0), (5.1, 1.0), (5.2, 1.0), (9.0, 1.0)]
    points = spark.createDataFrame([(y, Vectors.dense([x])) for x, y in rows], ["label", "features"])
    asked = spark.createDataFrame([(Vectors.dense([0.1]),)], ["features"])
    for kernel, expected in (("rectangular", 1.0), ("triangular", 0.0)):
        model = NeighbourVote("classification", 5, 2, kernel).fit(points)
        row = model.transform(asked).first()
        assert row.prediction == expected and sum(row.probability) == pytest.approx(1)


def test_naive_bayes_leaves_missing_features_out(spark):
    rows = [("a", 0.0, 0.0), ("a", 1.0, 1.0), ("b", 10.0, 0.5), ("b", 11.0, float("nan")), ("b", 12.0, None)]
    df = spark.createDataFrame(rows, "c string, x double, y double")
    model = gaussian_nb(df, ["x", "y"], "c")
    asked = spark.createDataFrame([(11.0, None), (0.5, float("nan")), (None, None)], "x double, y double")
    got = [r.prediction for r in gaussian_nb_predict(asked, model, ["x", "y"]).collect()]
    assert got == ["b", "a", "b"]


def test_importance_shares_are_of_all_features(spark):
    # of the 20 largest alone the first would have 56 % and be called dominant
    learner = SimpleNamespace(coefficients=Vectors.dense([0.3] + [0.0125] * 56))
    model = SimpleNamespace(learner=learner, recipe=SimpleNamespace(features=[f"f{i:02}" for i in range(57)]))
    found = importance(spark, model)
    assert found.count() == 57
    top = importance_findings(found).filter("rank = 1").first()
    assert (top.item, top.value, top.band) == ("f00", 30.0, None)


def test_fourier_map_goes_through_flat_buffers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    rows = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["id", "features"])
    mapped = RandomFourierFeatures(inputCol="features", outputCol="out", gamma=0.25, size=8, seed=5).transform(
        rows.repartition(3)
    )
    random = np.random.default_rng(5)
    weights, shift = random.normal(0, np.sqrt(0.5), (4, 8)), random.uniform(0, 2 * np.pi, 8)
    wanted = np.sqrt(2 / 8) * np.cos(x @ weights + shift)
    got = {r.id: r.out.toArray() for r in mapped.collect()}
    assert all(np.allclose(got[i], wanted[i], rtol=1e-12) for i in range(50))

def test_few_rows_do_not_keep_many_tasks(spark):
    # each of hundreds of short jobs pays for every task
    rows = spark.range(0, 225_000, 1, 24).select("id", (F.col("id") % 2).cast("double").alias("x"))
    fitted = Recipe("id", []).fit(rows)
    assert _features(fitted, rows, F.col("x"), [], True, 225_000).rdd.getNumPartitions() == 9


def test_blocks_send_numbers_of_points_and_keep_ties_by_key(spark, monkeypatch):
    monkeypatch.setattr("mlscout.operators.neighbours.CHUNK_CELLS", 50)
    near = [(f"k{i:03d}", [float(i % 5), float(i // 5 % 5)]) for i in range(75)]
    asked = [[float(i), float(j)] for i in range(5) for j in range(5)]
    out = nearest_neighbours(
        spark.createDataFrame(near, "key string, point array<double>"),
        spark.createDataFrame([(p,) for p in asked], "point array<double>"),
        4, block_rows=7, points_per_pivot=20,
    )
    got = {(tuple(r.point), r["rank"]): (r.distance, r.key) for r in out.collect()}
    for p in asked:
        best = sorted((float(np.sqrt(((np.array(q) - p) ** 2).sum())), key) for key, q in near)[:4]
        assert [got[tuple(p), i + 1] for i in range(4)] == best
    plan = out._jdf.queryExecution().toString().splitlines()
    assert all("point" not in line.split("block_top", 1)[1].rsplit("[", 1)[1] for line in plan if "block_top" in line)
    assert any("block_top" in line for line in plan)


def test_huber_machine_reaches_the_optimum_and_stores_no_mapped_rows(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import LinearRegression

    from mlscout.plans.huber import FourierHuber

    x = F.array(F.sin("id"), F.cos(F.col("id") * 3))
    far = F.when(F.col("id") % 10 == 0, 80.0).otherwise(0.0)
    rows = spark.range(600).select(
        array_to_vector(x).alias("features"),
        (F.sin("id") * 30 + F.cos(F.col("id") * 3) * 9 + far + F.cos(F.col("id") * 31)).alias("label"),
    ).cache()
    machine = make_estimator("kernlab", "regression", {"n_features": 6, "cost": 0.05}, n_rows=600, n_inputs=2)
    assert isinstance(machine, FourierHuber)
    passes, sums = [], machine._sums
    machine._sums = lambda *given: passes.append(1) or sums(*given)
    model = machine.fit(rows)
    assert len(passes) <= 12
    mapped = RandomFourierFeatures(inputCol="features", outputCol="mapped", gamma=0.5, size=6, seed=123).transform(rows)
    exact = LinearRegression(
        featuresCol="mapped", loss="huber", regParam=1 / (0.05 * 600), maxIter=3000, tol=1e-13
    ).fit(mapped)
    pairs = zip(
        model.transform(rows.coalesce(1)).select("prediction").collect(),
        exact.transform(mapped.coalesce(1)).select("prediction").collect(),
    )
    assert max(abs(a.prediction - b.prediction) for a, b in pairs) < 1e-3
    model.write().save(str(tmp_path / "machine"))
    again = PipelineModel.load(str(tmp_path / "machine"))
    assert again.transform(rows.coalesce(1)).collect() == model.transform(rows.coalesce(1)).collect()
