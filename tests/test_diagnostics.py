import numpy as np
import pytest

from mlscout.operators import diagnostics as D


def _frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "residual double")


def test_shapiro_wilk_known_value(spark):
    # weights of eleven men, a textbook sample
    sample = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    w, p = D.shapiro_wilk(_frame(spark, sample))
    assert w == pytest.approx(0.79, abs=0.005)
    assert p == pytest.approx(0.0067, abs=0.001)


def test_shapiro_wilk_separates_shapes(spark):
    rng = np.random.default_rng(3)
    assert D.normality(_frame(spark, rng.normal(size=800))).first().warning is False
    assert D.normality(_frame(spark, rng.exponential(size=800))).first().warning is True
    assert D.shapiro_wilk(_frame(spark, [1, 2])) is None
    assert D.shapiro_wilk(_frame(spark, [4, 4, 4, 4])) is None


def test_large_samples_get_a_scalable_test(spark):
    rng = np.random.default_rng(3)
    row = D.normality(_frame(spark, rng.normal(size=5000))).first()
    assert row.test == "inspect_qq_plot" and row.warning is False


def test_two_variance_regimes(spark):
    rng = np.random.default_rng(5)
    rows = [(float(i), float(rng.normal(scale=1 if i < 100 else 5))) for i in range(200)]
    df = spark.createDataFrame(rows, "fitted double, residual double")
    assert D.homoscedasticity(df).first().warning is True
    assert D.homoscedasticity(df.limit(5)).isEmpty()


def _metrics(spark, **values):
    return spark.createDataFrame(
        [(k, "standard", float(v)) for k, v in values.items()],
        "metric string, estimator string, estimate double",
    )


def _cv(spark, **values):
    return spark.createDataFrame(
        [(k, float(v)) for k, v in values.items()], "metric string, mean double"
    )


@pytest.mark.parametrize(
    "test, verdict", [(1.1501, "overfit"), (1.1499, "good"), (0.9501, "good"), (0.9499, "unusual")]
)
def test_regression_overfit_bands(spark, test, verdict):
    assert D.overfit_regression(_cv(spark, rmse=1), _metrics(spark, rmse=test)).first().verdict == verdict


@pytest.mark.parametrize("test, verdict", [(0.84, "overfit"), (0.86, "good"), (0.94, "good"), (0.96, "unusual")])
def test_class_overfit_bands(spark, test, verdict):
    cv, metrics = _cv(spark, accuracy=0.9), _metrics(spark, accuracy=test)
    assert D.overfit_classification(cv, metrics).first().verdict == verdict


def test_no_cross_validation_no_verdict(spark):
    assert D.overfit_regression(_cv(spark, rsq=1), _metrics(spark, rmse=1)).isEmpty()


@pytest.mark.parametrize(
    "rmse, rsq, verdict",
    [(1.1, 0.75, "consistent"), (1.2, 0.8, "overfit"), (1.0, 0.6, "overfit"), (0.8, 0.8, "unusually_better")],
)
def test_drift_regression(spark, rmse, rsq, verdict):
    found = D.drift_regression(_metrics(spark, rmse=1, rsq=0.8), _metrics(spark, rmse=rmse, rsq=rsq))
    assert found.first().verdict == verdict


@pytest.mark.parametrize("new, verdict", [(0.84, "consistent"), (0.74, "overfit"), (0.86, "unusually_better")])
def test_drift_classification(spark, new, verdict):
    found = D.drift_classification(_metrics(spark, accuracy=0.8), _metrics(spark, accuracy=new))
    assert found.first().verdict == verdict


def test_lift_bands(spark):
    base = spark.createDataFrame([("mean", 10.0, 0.0)], "strategy string, baseline_rmse double, baseline_rsq double")
    for rmse, band in ((4, "strong"), (7, "positive"), (9, "modest"), (9.9, "weak"), (11, "worse_than_baseline")):
        assert D.baseline_lift(_metrics(spark, rmse=rmse), base, "regression").first().band == band


def test_baseline_tie_goes_to_the_first_level(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "y string")
    row = D.baseline_classification(df, "y").first()
    assert (row.baseline_class, row.baseline_accuracy) == ("a", 0.5)
