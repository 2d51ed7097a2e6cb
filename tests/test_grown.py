import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from mlscout.plans import grown
from mlscout.plans.estimators import make_estimator


@pytest.fixture(scope="module")
def few_values(spark):
    """Every value has a bin of its own here, so Spark's trees see the same splits."""
    x = F.array((F.col("id") % 7).cast("double"), F.floor(F.sin("id") * 6), (F.col("id") % 3).cast("double"))
    y = F.col("id") % 7 * 3.0 + F.floor(F.sin("id") * 6) ** 2 + F.cos(F.col("id") * 31)
    return spark.range(0, 3000, 1, 3).select(array_to_vector(x).alias("features"), y.alias("label")).cache()


def _pairs(a, b, rows, column):
    return zip(*([r[0] for r in m.transform(rows).select(column).collect()] for m in (a, b)))


def test_boosting_equals_sparks_where_every_value_has_a_bin(few_values, tmp_path, monkeypatch):
    monkeypatch.setattr(grown, "REFRESH", 3)
    options = {"maxDepth": 3, "stepSize": 0.1, "minInstancesPerNode": 5}
    settings = {"learn_rate": 0.1, "depth": 3, "min_n": 5}
    own = make_estimator("xgboost", "regression", {**settings, "trees": 8}).fit(few_values)
    for a, b in _pairs(GBTRegressor(maxIter=8, **options).fit(few_values), own, few_values, "prediction"):
        assert a == pytest.approx(b, rel=1e-9)
    two = few_values.withColumn("label", (F.col("label") > 20).cast("double")).cache()
    theirs = GBTClassifier(maxIter=8, **options).fit(two)
    own = make_estimator("xgboost", "classification", {**settings, "trees": 8}).fit(two)
    for a, b in _pairs(theirs, own, two, "probability"):
        assert list(a) == pytest.approx(b, abs=1e-9)
    assert all(a == b for a, b in _pairs(theirs, own, two, "prediction"))
    assert own.stages[-1].getOrDefault("importances") == pytest.approx(theirs.featureImportances.toArray().tolist())
    own.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(two).select("probability").collect() == own.transform(two).select("probability").collect()


@pytest.mark.parametrize("engine", ["xgboost", "ranger"])
@pytest.mark.parametrize("task", ["regression", "classification"])
def test_levels_read_cells_not_rows(few_values, monkeypatch, engine, task):
    read, plain = [], grown._histograms
    monkeypatch.setattr(grown, "_histograms", lambda cells, *rest: read.append(cells.count()) or plain(cells, *rest))
    rows = few_values.withColumn("label", F.floor(F.col("label") / 20) + 1) if task == "classification" else few_values
    n_classes = int(rows.agg(F.max("label")).first()[0]) + 1
    model = make_estimator(engine, task, {"trees": 2, "depth": 2}, n_classes=n_classes).fit(rows)
    assert len(read) == (4 if engine == "xgboost" else 2) and set(read) == {7 * 12 * 3}
    if task == "classification":
        sums = model.transform(rows).select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x).alias("s"))
        assert sums.filter("abs(s - 1) > 1e-9").isEmpty()


def test_forest_bags_rows_within_cells(few_values):
    rows = grown._rows(few_values)
    cuts = grown.find_cuts(rows)
    plain = grown.cells_of(rows, cuts, 0).agg(F.sum("s0"), F.sum("s1")).first()
    bagged = grown.cells_of(rows, cuts, 0, bags=30, seed=5)
    counts = bagged.agg(*[F.sum(f"s{2 * i}") for i in range(30)]).first()
    assert plain[0] == 3000 and plain[1] == pytest.approx(rows.agg(F.sum("y")).first()[0])
    # sums of 3000 draws: a cell drawn as one would spread them by sqrt(12) times as much
    assert abs(np.mean(counts) - 3000) < 50 and 30 < np.std(counts) < 80
    model = make_estimator("ranger", "regression", {"trees": 25, "depth": 6, "mtry_share": 1.0}).fit(few_values)
    theirs = RandomForestRegressor(
        numTrees=25, maxDepth=6, minInstancesPerNode=5, featureSubsetStrategy="1.0", seed=1
    ).fit(few_values)
    squares = F.avg((F.col("prediction") - F.col("label")) ** 2)
    own, other = (m.transform(few_values).agg(squares).first()[0] for m in (model, theirs))
    assert own < 1.2 * other


def test_bins_missing_values_and_many_features(spark, monkeypatch):
    monkeypatch.setattr(grown, "TABLE_CELLS", 4)
    wide = [F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("id") * 0.37)]
    wide += [(F.col("id") * (i % 10 + 1) % 11).cast("double") for i in range(12)]
    rows = spark.range(0, 9000, 1, 3).select(
        array_to_vector(F.array(*wide)).alias("features"),
        F.when(F.col("id") % 5 == 0, 50.0).otherwise((F.col("id") > 4500).cast("double")).alias("label"),
    )
    cuts = grown.find_cuts(grown._rows(rows))
    assert len(cuts[0]) == 63 and [len(c) for c in cuts[1:]] == [10] * 12
    model = make_estimator("xgboost", "regression", {"trees": 3, "depth": 2, "learn_rate": 0.1}).fit(rows)
    # a missing value shares the last bin, as in Spark's trees; scores with and without the table agree
    last = F.expr("transform(x, (v, i) -> if(i = 0 and isnan(v), 1e9D, v))")
    filled = grown._rows(rows).select(array_to_vector(last).alias("features"))
    few = [r.prediction for r in model.transform(rows).select("prediction").collect()]
    assert few == [r.prediction for r in model.transform(filled).select("prediction").collect()]
    monkeypatch.setattr(grown, "TABLE_CELLS", 1 << 20)
    assert few == [r.prediction for r in model.transform(rows).select("prediction").collect()]
    assert len(set(few)) > 2
    flat = rows.withColumn("label", F.lit(1 / 3))
    model = make_estimator("ranger", "regression", {"trees": 2, "depth": 3}).fit(flat)
    assert model.transform(flat).filter("abs(prediction - 1D / 3) > 1e-9").isEmpty()
