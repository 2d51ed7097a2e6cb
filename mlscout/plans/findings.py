"""Findings about a trained model as rows: ``(seq, section, item, value, band, advice)``.

Thresholds decide the band; ``advice`` is a short code a front end can spell out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mlscout.functions.hashing import HASH_RANGE, key_columns, row_hash
from mlscout.functions.text import html_escape, number_text
from mlscout.operators.diagnostics import (
    LINEAR_ENGINES,
    baseline_classification,
    baseline_lift,
    baseline_regression,
    homoscedasticity,
    normality,
    overfit_classification,
    overfit_regression,
    residual_bins,
    residuals,
)
from mlscout.operators.recommend import display_name
from mlscout.operators.task import REGRESSION
from mlscout.plans.train import Comparison, TrainResult

FINDING_COLUMNS = ["section", "item", "value", "band", "advice"]

# Lower bound of each band, best first.
RSQ_BANDS = [(0.9, "very strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak")]
RSQ_LOWEST = "very weak"
RSQ_TIERS = [(0.7, "strong"), (0.5, "moderate")]
ACCURACY_BANDS = [(0.95, "very strong"), (0.85, "good"), (0.75, "fair"), (0.65, "moderate")]
ACCURACY_LOWEST = "needs improvement"
ACCURACY_TIERS = [(0.85, "good"), (0.7, "decent")]
LOWEST_TIER = "limited"
F1_BANDS = [(0.9, "very strong"), (0.8, "good"), (0.7, "fair")]
AUC_BANDS = [(0.9, "very strong"), (0.8, "good"), (0.7, "fair"), (0.6, "poor")]
PR_GAP = 0.1
TRAFFIC_LIGHTS = {"rsq": (0.3, 0.5, 0.7), "accuracy": (0.65, 0.75, 0.85)}
IMPROVE_BELOW = {"rsq": 0.5, "accuracy": 0.8}
GOOD_FROM = {"rsq": 0.7, "accuracy": 0.85}
TOP_FEATURES = 5

# Our own rules: what was measured, the test that makes it worth a remark, the remark.
REMARKS = {
    "regression": [
        ("rsq", f"rsq < {IMPROVE_BELOW['rsq']}", "fit_misses_half_of_the_variation"),
        ("rmse", "rmse > 1.5 * mae", "few_large_errors_dominate"),
    ],
    "classification": [
        ("accuracy", f"accuracy < {IMPROVE_BELOW['accuracy']}", "errors_are_frequent"),
        ("precision", f"precision < recall - {PR_GAP}", "false_alarms_prevail"),
        ("recall", f"recall < precision - {PR_GAP}", "misses_prevail"),
        ("roc_auc", "roc_auc < 0.7", "scores_order_rows_poorly"),
    ],
}
DOMINANT_SHARE = 50.0  # percent of the importance from which one feature carries a model


def _at_least(value: Column, bands: list[tuple[float, str]], lowest: str, strict: bool = False) -> Column:
    out = F.when(value.isNull(), F.lit("unknown"))
    for limit, name in bands:
        out = out.when(value > limit if strict else value >= limit, F.lit(name))
    return out.otherwise(F.lit(lowest))


def _wide(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row with the named estimates; the metric table has a handful of rows."""
    return metrics.agg(
        *[F.max(F.when(F.col("metric") == n, F.col("estimate"))).alias(n) for n in names]
    )


def _rows(wide: DataFrame, rows: list[tuple[str, str, Column, Column, Column]]) -> DataFrame:
    none = F.lit(None).cast("string")
    entries = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(item).alias("item"),
            value.cast("double").alias("value"),
            (band if band is not None else none).alias("band"),
            (advice if advice is not None else none).alias("advice"),
        )
        for section, item, value, band, advice in rows
    ]
    return wide.select(F.inline(F.array(*entries)))


def regression_findings(metrics: DataFrame) -> DataFrame:
    """Bands of r-squared, the practical tier, and the error metrics."""
    wide = _wide(metrics, ["rsq", "rmse", "mae"])
    rsq = F.col("rsq")
    tier = F.when(rsq.isNull(), F.lit(LOWEST_TIER)).otherwise(_at_least(rsq, RSQ_TIERS, LOWEST_TIER))
    return _rows(
        wide,
        [
            ("metrics", "rsq", rsq, _at_least(rsq, RSQ_BANDS, RSQ_LOWEST), None),
            ("metrics", "rmse", F.col("rmse"), None, None),
            ("metrics", "mae", F.col("mae"), None, None),
            ("practical", "rsq", rsq, tier, None),
        ],
    )


def classification_findings(metrics: DataFrame) -> DataFrame:
    """Bands of accuracy, the practical tier, and the class metrics."""
    wide = _wide(metrics, ["accuracy", "precision", "recall"])
    acc = F.col("accuracy")
    tier = F.when(acc.isNull(), F.lit(LOWEST_TIER)).otherwise(
        _at_least(acc, ACCURACY_TIERS, LOWEST_TIER)
    )
    return _rows(
        wide,
        [
            ("metrics", "accuracy", acc, _at_least(acc, ACCURACY_BANDS, ACCURACY_LOWEST), None),
            ("metrics", "precision", F.col("precision"), None, None),
            ("metrics", "recall", F.col("recall"), None, None),
            ("practical", "accuracy", acc, tier, None),
        ],
    )


def pr_balance(metrics: DataFrame) -> DataFrame:
    """Conservative when precision leads by more than 0.1, aggressive when recall does."""
    wide = _wide(metrics, ["precision", "recall"]).filter(
        "precision IS NOT NULL AND recall IS NOT NULL"
    )
    gap = F.col("precision") - F.col("recall")
    band = (
        F.when(F.col("precision") > F.col("recall") + PR_GAP, "conservative")
        .when(F.col("recall") > F.col("precision") + PR_GAP, "aggressive")
        .otherwise("balanced")
    )
    return _rows(wide, [("metrics", "precision_recall", gap, band, None)])


def f1_auc_bands(metrics: DataFrame) -> DataFrame:
    wide = _wide(metrics, ["f_meas", "roc_auc"])
    f1, auc = F.col("f_meas"), F.col("roc_auc")
    rows = _rows(
        wide,
        [
            ("metrics", "f_meas", f1, _at_least(f1, F1_BANDS, "needs improvement", True), None),
            ("metrics", "roc_auc", auc, _at_least(auc, AUC_BANDS, "random"), None),
        ],
    )
    return rows.filter("value IS NOT NULL")


def importance_findings(importance: DataFrame) -> DataFrame:
    """Top features with their share of the importance of all features, in percent (1 dp)."""
    # one row per feature of a model
    all_rows = Window.partitionBy(F.lit(0))
    total = F.sum("importance").over(all_rows)
    place = F.row_number().over(all_rows.orderBy(F.desc("importance"), "variable"))
    share = F.round(F.try_divide(F.col("importance") * 100, total), 1)
    return (
        importance.withColumns({"rank": place, "value": share})
        .filter(F.col("rank") <= TOP_FEATURES)
        .select(
            "rank",
            F.lit("importance").alias("section"),
            F.col("variable").alias("item"),
            "value",
            F.when(F.col("value") >= DOMINANT_SHARE, "dominant").alias("band"),
            F.when(F.col("value") >= DOMINANT_SHARE, "check_that_it_is_known_beforehand").alias("advice"),
        )
    )


def recommendations(metrics: DataFrame, importance: DataFrame | None, task_type: str) -> DataFrame:
    """A remark for every measure that gives cause for one, and the strongest feature."""
    rules = REMARKS["regression" if task_type == REGRESSION else "classification"]
    names = sorted({m for m, *_ in rules} | ({"mae"} if task_type == REGRESSION else set()))
    wide = _wide(metrics, names)
    remarks = F.array(
        *[
            F.struct(
                F.lit(m).alias("item"), F.col(m).alias("value"), F.lit(text).alias("advice"),
                F.expr(test).alias("_holds"),
            )
            for m, test, text in rules
        ]
    )
    out = wide.select(F.inline(remarks)).filter("_holds").select(
        F.lit("remark").alias("section"), "item", "value", F.lit(None).cast("string").alias("band"), "advice"
    )
    if importance is None:
        return out
    top = importance_findings(importance).filter("rank = 1")
    return out.unionByName(top.select(F.lit("key_finding").alias("section"), "item", "value", "band", "advice"))


def next_steps(metrics: DataFrame, engine: str, task_type: str) -> DataFrame:
    """A good model goes to new rows; else other kinds of engines are worth a comparison.

    One row per step: state, seq, step, suggested. The current engine is never suggested.
    """
    name = "rsq" if task_type == REGRESSION else "accuracy"
    # one linear, one single tree, one ensemble: what does better tells what the model lacks
    others = [e for e in ("glmnet", "rpart", "xgboost") if e != engine]
    steps = [("good", 1, "score_new_rows", None)]
    steps += [("improve", i, "compare_engine", e) for i, e in enumerate(others, 1)]
    table = metrics.sparkSession.createDataFrame(
        steps, "state string, seq int, step string, suggested string"
    )
    state = F.when(F.col(name) >= GOOD_FROM[name], "good").otherwise("improve")
    current = _wide(metrics, [name]).select(state.alias("state"))
    return table.join(F.broadcast(current), "state", "left_semi").orderBy("seq")


def traffic_light(value: Column, metric: str) -> Column:
    low, middle, high = TRAFFIC_LIGHTS.get(metric, TRAFFIC_LIGHTS["rsq"])
    return (
        F.when(value.isNull() | F.isnan(value.cast("double")), "gray")
        .when(value >= high, "green")
        .when(value >= middle, "yellow")
        .when(value >= low, "orange")
        .otherwise("red")
    )


def metric_cards(metrics: DataFrame, task_type: str) -> DataFrame:
    """Primary and secondary metrics as display text with the primary one's colour."""
    none = F.lit(None).cast("string")

    def card(seq: int, role: str, name: str, text: Column, color: Column) -> Column:
        return F.struct(
            F.lit(seq).alias("seq"), F.lit(role).alias("role"), F.lit(name).alias("name"),
            text.alias("value"), color.alias("color"),
        )

    def plain(name: str, digits: int) -> Column:
        return number_text(F.col(name), digits)

    def percent(name: str) -> Column:
        return F.concat(number_text(F.col(name) * 100, 1), F.lit("%"))

    def known(text: Column) -> Column:
        return F.coalesce(text, F.lit("N/A"))

    if task_type == REGRESSION:
        wide = _wide(metrics, ["rsq", "rmse", "mae"])
        cards = [
            card(1, "primary", "R-squared", known(plain("rsq", 3)), traffic_light(F.col("rsq"), "rsq")),
            card(2, "secondary", "RMSE", known(plain("rmse", 2)), none),
            card(3, "secondary", "MAE", known(plain("mae", 2)), none),
        ]
        return wide.select(F.inline(F.array(*cards)))
    wide = _wide(metrics, ["accuracy", "precision", "recall", "roc_auc"])
    color = traffic_light(F.col("accuracy"), "accuracy")
    cards = [
        card(1, "primary", "Accuracy", known(percent("accuracy")), color),
        card(2, "secondary", "Precision", percent("precision"), none),
        card(3, "secondary", "Recall", percent("recall"), none),
        card(4, "secondary", "AUC", plain("roc_auc", 3), none),
    ]
    return wide.select(F.inline(F.array(*cards))).filter("value IS NOT NULL")


def explain_comparison(table: DataFrame, task_type: str) -> DataFrame:
    """One line per model, best first. ``table`` is a ranked comparison table."""
    if task_type == REGRESSION and "rsq" in table.columns:
        text = F.concat(F.lit(": R-squared = "), number_text(F.col("rsq"), 3))
    elif "accuracy" in table.columns:
        text = F.concat(F.lit(": Accuracy = "), number_text(F.col("accuracy") * 100, 1), F.lit("%"))
    else:
        text = F.lit(": N/A")
    name = display_name(F.col("model"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), name, F.coalesce(text, F.lit(": N/A")))
    return table.select("rank", "model", line.alias("line")).orderBy("rank")


def explain(result: TrainResult) -> DataFrame:
    """All findings in reading order: summary, metrics, importance, baseline,
    overfitting, assumptions, split note, recommendations."""
    spark = result.test_metrics.sparkSession
    regression = result.task_type == REGRESSION
    target = result.target
    none = F.lit(None).cast("string")
    summary = spark.createDataFrame(
        [
            ("summary", "engine", None, result.engine, None),
            ("summary", "target", None, target, None),
            ("summary", "n_train", float(result.n_train), None, None),
            ("summary", "n_test", float(result.n_test), None, None),
        ],
        "section string, item string, value double, band string, advice string",
    )
    metrics = result.test_metrics
    parts = [summary]
    if regression:
        parts.append(regression_findings(metrics))
        baseline = baseline_regression(result.predictions, target)
    else:
        parts += [classification_findings(metrics), pr_balance(metrics), f1_auc_bands(metrics)]
        baseline = baseline_classification(result.predictions, target)
    if result.importance is not None:
        parts.append(importance_findings(result.importance).drop("rank"))
    lift = baseline_lift(metrics, baseline, result.task_type)
    parts.append(_rows(lift, [("baseline", "lift", F.col("lift"), F.col("band"), None)]))
    if result.cv_metrics is not None:
        overfit = overfit_regression if regression else overfit_classification
        verdict = overfit(result.cv_metrics, metrics)
        parts.append(
            _rows(verdict, [("overfitting", "change", F.col("change"), F.col("verdict"), None)])
        )
    if regression and result.engine in LINEAR_ENGINES:
        rows = residuals(result.predictions, target, "prediction")
        warned = F.when(F.col("warning"), "warning").otherwise("ok")
        advice = F.when(F.col("warning"), "transform_target_or_use_trees")
        parts.append(
            normality(rows).select(
                F.lit("assumptions").alias("section"), F.concat(F.lit("normality:"), "test").alias("item"),
                F.col("p_value").alias("value"), warned.alias("band"), advice.alias("advice"),
            )
        )
        parts.append(
            homoscedasticity(rows).select(
                F.lit("assumptions").alias("section"), F.lit("variance_ratio").alias("item"),
                F.col("ratio").alias("value"), warned.alias("band"), advice.alias("advice"),
            )
        )
    if result.split_message:
        parts.append(
            spark.range(1).select(
                F.lit("split").alias("section"), F.lit("note").alias("item"),
                F.lit(None).cast("double").alias("value"), none.alias("band"),
                F.lit(result.split_message).alias("advice"),
            )
        )
    parts.append(recommendations(metrics, result.importance, result.task_type))
    out = None
    for seq, part in enumerate(parts):
        numbered = part.select(F.lit(seq).alias("seq"), *FINDING_COLUMNS)
        out = numbered if out is None else out.unionByName(numbered)
    return out.orderBy("seq")


# -- chart tables -------------------------------------------------------------


def importance_chart(importance: DataFrame, k: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "variable").limit(k)


def pred_vs_actual(
    df: DataFrame, y: str, yhat: str, n: int, key: str | Sequence[str] | None = None, seed: int = 123
) -> DataFrame:
    """About ``n`` points chosen by hash, for a scatter plot of any number of rows."""
    rows = residuals(df, y, yhat)
    keys = [y, yhat] if key is None else key_columns(df, key)
    total = rows.count()
    share = min(1.0, n / total) if total else 1.0
    return rows.filter(row_hash(keys, seed) < int(share * HASH_RANGE)).select(
        F.col(y).alias("actual"), F.col("fitted").alias("predicted")
    )


def residual_chart(df: DataFrame, y: str, yhat: str, bins: int = 20) -> DataFrame:
    """Bin means of the residual in place of a smooth trend line."""
    return residual_bins(residuals(df, y, yhat), bins)


# -- report -------------------------------------------------------------------


def report_lines(result: TrainResult, comparison: Comparison | None = None) -> DataFrame:
    """``(seq, line)`` HTML table rows; every value is escaped."""
    findings = explain(result).select(
        F.col("seq"),
        F.concat_ws(
            "</td><td>",
            html_escape(F.col("section")), html_escape(F.col("item")),
            html_escape(number_text(F.col("value"), 4)), html_escape(F.col("band")),
            html_escape(F.col("advice")),
        ).alias("line"),
    )
    out = findings
    if comparison is not None:
        lines = explain_comparison(comparison.table, result.task_type)
        out = out.unionByName(
            lines.select(
                (F.lit(1000) + F.col("rank")).alias("seq"),
                F.concat(F.lit("comparison</td><td>"), html_escape(F.col("line"))).alias("line"),
            )
        )
    return out.select("seq", F.concat(F.lit("<tr><td>"), "line", F.lit("</td></tr>")).alias("line"))


def write_report(result: TrainResult, path: str, comparison: Comparison | None = None) -> None:
    """One HTML text file; a report has some dozens of lines."""
    body = report_lines(result, comparison)
    frame = result.test_metrics.sparkSession.createDataFrame(
        [(-1, "<html><body><table>"), (1_000_000, "</table></body></html>")], "seq int, line string"
    )
    lines = frame.unionByName(body).coalesce(1).sortWithinPartitions("seq")
    lines.select("line").write.mode("overwrite").text(path)
