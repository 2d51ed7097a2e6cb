"""Baselines, residual checks, overfitting and drift verdicts."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlscout.functions.ordering import exact_quantiles
from mlscout.kinds import column, missing
from mlscout.operators.task import REGRESSION

LINEAR_ENGINES = ["lm", "glmnet"]

# Test and verdict thresholds.
SHAPIRO_MAX_ROWS = 5000
SHAPIRO_MIN_ROWS = 3
NORMALITY_ALPHA = 0.05
VARIANCE_MIN_ROWS = 10
VARIANCE_MIN_SIDE = 3
VARIANCE_FLOOR = 1e-10
VARIANCE_RATIO_HIGH = 2
VARIANCE_RATIO_LOW = 0.5
OVERFIT_RMSE = 0.15
OVERFIT_ACCURACY = 0.05
UNUSUAL = -0.05
RMSE_LIFT_BANDS = [(50, "strong"), (20, "positive"), (5, "modest"), (0, "weak")]
ACCURACY_LIFT_BANDS = [(0.25, "strong"), (0.10, "positive"), (0.03, "modest"), (0, "weak")]
DRIFT_SIMILAR_PCT = 10
DRIFT_VERDICT_PCT = 15
DRIFT_POINTS = 5


# -- baselines ----------------------------------------------------------------


def baseline_regression(df: DataFrame, y: str) -> DataFrame:
    """Error of always predicting the mean."""
    value = column(y).cast("double")
    return df.filter(~missing(df, y)).agg(
        F.lit("mean").alias("strategy"),
        F.sqrt(F.var_pop(value)).alias("baseline_rmse"),
        F.lit(0.0).alias("baseline_rsq"),
    )


def baseline_classification(df: DataFrame, y: str) -> DataFrame:
    """Accuracy of always predicting the most common class (tie: first level)."""
    counts = df.filter(~missing(df, y)).groupBy(column(y).alias("class")).agg(F.count("*").alias("n"))
    return counts.agg(
        F.lit("mode").alias("strategy"),
        F.min_by("class", F.struct(-F.col("n"), F.col("class"))).cast("string").alias("baseline_class"),
        F.try_divide(F.max("n"), F.sum("n")).alias("baseline_accuracy"),
    )


def _band(value: Column, bands: list[tuple[float, str]], lowest: str) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, name in bands:
        out = out.when(value > limit, F.lit(name))
    return out.otherwise(F.lit(lowest))


def _one_row(values: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Single values of several long tables side by side: one aggregate over their union.

    ``values`` maps an output name to (table, metric, value column).
    """
    tagged = None
    for name, (table, metric, value) in values.items():
        part = table.filter(F.col("metric") == metric).select(
            F.lit(name).alias("name"), column(value).cast("double").alias("value")
        )
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.agg(
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in values]
    )


def baseline_lift(metrics: DataFrame, baseline: DataFrame, task_type: str) -> DataFrame:
    """How far a model beats its baseline."""
    if task_type == REGRESSION:
        metric, source, bands = "rmse", "baseline_rmse", RMSE_LIFT_BANDS
    else:
        metric, source, bands = "accuracy", "baseline_accuracy", ACCURACY_LIFT_BANDS
    base = baseline.select(F.lit(metric).alias("metric"), column(source).alias("estimate"))
    both = _one_row(
        {
            "baseline_value": (base, metric, "estimate"),
            "model_value": (metrics, metric, "estimate"),
        }
    )
    if task_type == REGRESSION:
        lift = F.try_divide((F.col("baseline_value") - F.col("model_value")) * 100, "baseline_value")
    else:
        lift = F.col("model_value") - F.col("baseline_value")
    return both.withColumn("lift", lift).withColumn(
        "band", _band(F.col("lift"), bands, "worse_than_baseline")
    )


# -- residuals ----------------------------------------------------------------


def residuals(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """The input with ``fitted`` and ``residual``, for complete rows."""
    rows = df.filter(~missing(df, y) & ~missing(df, yhat))
    return rows.withColumns(
        {
            "fitted": column(yhat).cast("double"),
            "residual": column(y).cast("double") - column(yhat).cast("double"),
        }
    )


def jarque_bera(rows: DataFrame, residual: str = "residual") -> DataFrame:
    """Jarque-Bera statistic and p-value (chi-squared, 2 df): one aggregate for any size."""
    value = column(residual)
    statistic = F.col("n") / 6 * (F.pow("skew", F.lit(2)) + F.pow("excess", F.lit(2)) / 4)
    return (
        rows.agg(
            F.count(value).alias("n"),
            F.skewness(value).alias("skew"),
            F.kurtosis(value).alias("excess"),
        )
        .withColumn("statistic", statistic)
        .withColumn("p_value", F.exp(-F.col("statistic") / 2))
        .withColumn("warning", F.col("p_value") < NORMALITY_ALPHA)
    )


def _polynomial(coefficients: list[float], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def shapiro_wilk(rows: DataFrame, residual: str = "residual") -> tuple[float, float] | None:
    """W and p-value by Royston's 1995 approximation (AS R94), for 3 <= n < 5000.

    None outside that range or for constant values. The size is checked first, so the
    ordered window holds fewer than 5000 rows.
    """
    values = rows.select(column(residual).cast("double").alias("x")).filter("x IS NOT NULL")
    n = values.count()
    if not SHAPIRO_MIN_ROWS <= n < SHAPIRO_MAX_ROWS:
        return None
    normal = NormalDist()
    scores = [normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    norm = math.fsum(m * m for m in scores)
    u = 1 / math.sqrt(n)
    if n == 3:
        weights = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        # Published polynomial coefficients.
        last = scores[-1] / math.sqrt(norm) + _polynomial(
            [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], u
        )
        if n > 5:
            second = scores[-2] / math.sqrt(norm) + _polynomial(
                [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u
            )
            rest = (norm - 2 * scores[-1] ** 2 - 2 * scores[-2] ** 2) / (
                1 - 2 * last**2 - 2 * second**2
            )
            ends = [last, second]
        else:
            rest = (norm - 2 * scores[-1] ** 2) / (1 - 2 * last**2)
            ends = [last]
        weights = [m / math.sqrt(rest) for m in scores]
        for i, w in enumerate(ends):
            weights[i], weights[n - 1 - i] = -w, w
    spark = rows.sparkSession
    table = spark.createDataFrame(list(enumerate(weights, 1)), "rank int, weight double")
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("x")))
    row = ranked.join(F.broadcast(table), "rank").agg(
        F.sum(F.col("weight") * F.col("x")), F.var_pop("x") * n
    ).first()
    if not row[1]:
        return None
    w = min(row[0] ** 2 / row[1], 1.0)
    return w, _shapiro_p(w, n)


def _shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    y = math.log(1 - w)
    # Published polynomial coefficients.
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return 0.0
        y = -math.log(gamma - y)
        mean = _polynomial([0.5440, -0.39978, 0.025054, -6.714e-4], n)
        sd = math.exp(_polynomial([1.3822, -0.77857, 0.062767, -0.0020322], n))
    else:
        x = math.log(n)
        mean = _polynomial([-1.5861, -0.31082, -0.083751, 0.0038915], x)
        sd = math.exp(_polynomial([-0.4803, -0.082676, 0.0030302], x))
    return 1 - NormalDist().cdf((y - mean) / sd)


def normality(rows: DataFrame, residual: str = "residual") -> DataFrame:
    """Shapiro-Wilk below 5000 rows; above, Jarque-Bera with the advice to look at the plot."""
    spark = rows.sparkSession
    result = shapiro_wilk(rows, residual)
    if result is not None:
        w, p = result
        return spark.createDataFrame(
            [("shapiro_wilk", w, p, p < NORMALITY_ALPHA)],
            "test string, statistic double, p_value double, warning boolean",
        )
    return (
        jarque_bera(rows, residual)
        .filter(F.col("n") >= SHAPIRO_MAX_ROWS)
        .select(
            F.lit("inspect_qq_plot").alias("test"),
            "statistic",
            "p_value",
            (F.col("p_value") < NORMALITY_ALPHA).alias("warning"),
        )
    )


def homoscedasticity(
    rows: DataFrame, fitted: str = "fitted", residual: str = "residual"
) -> DataFrame:
    """Residual variance above the median fitted value over the variance below it.

    No row comes back when there are too few rows on a side or no variance.
    """
    (median,) = exact_quantiles(rows, [fitted], [0.5])[fitted]
    low = column(fitted) <= F.lit(median).cast("double")
    value = column(residual)
    sides = rows.agg(
        F.count("*").alias("n"),
        F.count_if(low).alias("n_low"),
        F.count_if(~low).alias("n_high"),
        F.var_samp(F.when(low, value)).alias("var_low"),
        F.var_samp(F.when(~low, value)).alias("var_high"),
    )
    ratio = F.col("var_high") / F.col("var_low")
    return (
        sides.filter(
            (F.col("n") >= VARIANCE_MIN_ROWS)
            & (F.col("n_low") >= VARIANCE_MIN_SIDE)
            & (F.col("n_high") >= VARIANCE_MIN_SIDE)
            & (F.col("var_low") > VARIANCE_FLOOR)
            & (F.col("var_high") > VARIANCE_FLOOR)
        )
        .withColumn("ratio", ratio)
        .withColumn(
            "warning",
            (F.col("ratio") > VARIANCE_RATIO_HIGH) | (F.col("ratio") < VARIANCE_RATIO_LOW),
        )
        .select("var_low", "var_high", "ratio", "warning")
    )


def qq_table(rows: DataFrame, residual: str = "residual", points: int = 99) -> DataFrame:
    """Normal quantile against exact residual quantile at evenly spread probabilities."""
    probs = [i / (points + 1) for i in range(1, points + 1)]
    found = exact_quantiles(rows, [residual], probs)[residual]
    normal = NormalDist()
    return rows.sparkSession.createDataFrame(
        [(p, normal.inv_cdf(p), q) for p, q in zip(probs, found)],
        "prob double, theoretical double, sample double",
    )


def residual_bins(
    rows: DataFrame, n: int = 20, fitted: str = "fitted", residual: str = "residual"
) -> DataFrame:
    """Mean and sd of the residual in equal-width bins of the fitted value."""
    low, high = rows.agg(F.min(fitted), F.max(fitted)).first()
    if low is None or low == high:
        slot = F.lit(1)
    else:
        slot = F.least(F.width_bucket(fitted, F.lit(low), F.lit(high), F.lit(n)), F.lit(n))
    return (
        rows.groupBy(slot.cast("int").alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.avg(fitted).alias("mean_fitted"),
            F.avg(residual).alias("mean_residual"),
            F.stddev_samp(residual).alias("sd_residual"),
        )
    )


# -- overfitting and drift ----------------------------------------------------


def _verdict(change: Column, limit: float) -> Column:
    return (
        F.when(change > limit, "overfit").when(change < UNUSUAL, "unusual").otherwise("good")
    )


def overfit_regression(cv: DataFrame, test: DataFrame) -> DataFrame:
    """Relative rise of the RMSE from cross-validation to test; no row without both."""
    left = cv.filter("metric = 'rmse'").select("metric", F.col("mean").alias("cv_value"))
    right = test.filter("metric = 'rmse'").select("metric", F.col("estimate").alias("test_value"))
    change = F.try_divide(F.col("test_value") - F.col("cv_value"), "cv_value")
    return (
        left.join(right, "metric")
        .withColumn("change", change)
        .withColumn("verdict", _verdict(F.col("change"), OVERFIT_RMSE))
    )


def overfit_classification(cv: DataFrame, test: DataFrame) -> DataFrame:
    """Loss of accuracy from cross-validation to test; no row without both."""
    left = cv.filter("metric = 'accuracy'").select("metric", F.col("mean").alias("cv_value"))
    right = test.filter("metric = 'accuracy'").select(
        "metric", F.col("estimate").alias("test_value")
    )
    return (
        left.join(right, "metric")
        .withColumn("change", F.col("cv_value") - F.col("test_value"))
        .withColumn("verdict", _verdict(F.col("change"), OVERFIT_ACCURACY))
    )


def drift_regression(test: DataFrame, new: DataFrame) -> DataFrame:
    """RMSE and r-squared on new data against the test rows, in percent, and a verdict."""
    both = _one_row(
        {
            "test_rmse": (test, "rmse", "estimate"),
            "test_rsq": (test, "rsq", "estimate"),
            "new_rmse": (new, "rmse", "estimate"),
            "new_rsq": (new, "rsq", "estimate"),
        }
    )
    for m in ("rmse", "rsq"):
        change = F.try_divide(F.col(f"new_{m}") - F.col(f"test_{m}"), f"test_{m}") * 100
        both = both.withColumn(f"{m}_change_pct", change)
    rmse_change, rsq_change = F.col("rmse_change_pct"), F.col("rsq_change_pct")
    limit = DRIFT_VERDICT_PCT
    return both.withColumns(
        {
            "rmse_note": F.when(F.abs(rmse_change) < DRIFT_SIMILAR_PCT, "similar")
            .when(rmse_change > 0, "worse")
            .otherwise("better"),
            "rsq_note": F.when(F.abs(rsq_change) < DRIFT_SIMILAR_PCT, "generalizes")
            .when(rsq_change < 0, "degraded")
            .otherwise("unusually_better"),
            "verdict": F.when(
                (F.abs(rmse_change) < limit) & (F.abs(rsq_change) < limit), "consistent"
            )
            .when((rmse_change > limit) | (rsq_change < -limit), "overfit")
            .otherwise("unusually_better"),
        }
    )


def drift_classification(test: DataFrame, new: DataFrame) -> DataFrame:
    """Accuracy on new data against the test rows, in percentage points, and a verdict."""
    both = _one_row(
        {
            "test_accuracy": (test, "accuracy", "estimate"),
            "new_accuracy": (new, "accuracy", "estimate"),
        }
    )
    change = F.col("change_points")
    return (
        both.withColumn("change_points", (F.col("new_accuracy") - F.col("test_accuracy")) * 100)
        .withColumn(
            "note",
            F.when(F.abs(change) < DRIFT_POINTS, "similar").when(change < 0, "worse").otherwise("better"),
        )
        .withColumn(
            "verdict",
            F.when(F.abs(change) < DRIFT_POINTS, "consistent")
            .when(change < -DRIFT_POINTS, "overfit")
            .otherwise("unusually_better"),
        )
    )
