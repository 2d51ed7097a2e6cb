"""Evaluation metrics as aggregations over a prediction table.

Every metric returns ``(metric, estimator, estimate)`` rows; undefined metrics are
left out. ``by`` columns evaluate many models or folds in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlscout.functions.ordering import MAX_GROUP_ROWS, prefix_sums
from mlscout.functions.text import number_text
from mlscout.kinds import column, missing
from mlscout.operators.task import REGRESSION

STANDARD = "standard"
FEW_LEVELS = 16  # classes that are counted in a column each


def _long(wide: DataFrame, by: Sequence[str], metrics: Sequence[tuple[str, str, Column]]) -> DataFrame:
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.lit(estimator).alias("estimator"),
                value.cast("double").alias("estimate"),
            )
            for name, estimator, value in metrics
        ]
    )
    return wide.select(*by, F.inline(entries)).filter("estimate IS NOT NULL")


def _complete(df: DataFrame, *names: str) -> DataFrame:
    out = df
    for name in names:
        out = out.filter(~missing(df, name))
    return out


# -- regression ---------------------------------------------------------------


def _regression(df: DataFrame, y: str, yhat: str, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    rows = _complete(df, y, yhat)
    actual, fitted = column(y).cast("double"), column(yhat).cast("double")
    error = actual - fitted
    parts = {
        "rmse": F.sqrt(F.avg(error * error)),
        "rsq": F.pow(
            F.try_divide(
                F.covar_samp(actual, fitted), F.stddev_samp(actual) * F.stddev_samp(fitted)
            ),
            F.lit(2.0),
        ),
        "mae": F.avg(F.abs(error)),
        # rows whose actual value is 0 are left out
        "mape": F.avg(F.try_divide(F.abs(error), F.abs(actual))) * 100,
    }
    wide = rows.groupBy(*by).agg(*[parts[n].alias(n) for n in names])
    return _long(wide, by, [(n, STANDARD, F.col(n)) for n in names])


def rmse(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    return _regression(df, y, yhat, by, ["rmse"])


def rsq(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Squared Pearson correlation (not 1 - SSE/SST); undefined for a constant side."""
    return _regression(df, y, yhat, by, ["rsq"])


def mae(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    return _regression(df, y, yhat, by, ["mae"])


def mape(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    return _regression(df, y, yhat, by, ["mape"])


# -- classification -----------------------------------------------------------


def confusion_counts(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (actual, predicted): the only shuffle class metrics need."""
    return (
        _complete(df, y, yhat)
        .select(*by, column(y).alias("actual"), column(yhat).alias("predicted"))
        .groupBy(*by, "actual", "predicted")
        .agg(F.count("*").alias("n"))
    )


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Confusion matrix with the percent of the actual class and a cell label."""
    counts = confusion_counts(df, y, yhat)
    of_actual = Window.partitionBy("actual")  # one row per predicted class
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(of_actual)).withColumn(
        "label",
        F.concat(F.col("n").cast("string"), F.lit(" ("), number_text(F.col("pct"), 1), F.lit("%)")),
    )


def class_distribution(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Rows per class as actual and as predicted class."""
    sides = F.array(
        F.struct(column(y).cast("string").alias("class"), F.lit(1).alias("a"), F.lit(0).alias("p")),
        F.struct(column(yhat).cast("string").alias("class"), F.lit(0).alias("a"), F.lit(1).alias("p")),
    )
    return (
        df.select(F.inline(sides))
        .filter("class IS NOT NULL")
        .groupBy("class")
        .agg(F.sum("a").alias("n_actual"), F.sum("p").alias("n_predicted"))
    )


def _class_metrics(
    df: DataFrame,
    y: str,
    yhat: str,
    by: Sequence[str],
    names: Sequence[str],
    positive: object = None,
    n_levels: int | None = None,
) -> DataFrame:
    """Binary: the positive class (default: first level). More classes: macro means."""
    counts = confusion_counts(df, y, yhat, by)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("actual").alias("class"), F.col("n").alias("support"), none.alias("called"),
            hit.cast("bigint").alias("hits"),
        ),
        F.struct(
            F.col("predicted").alias("class"), none.alias("support"), F.col("n").alias("called"),
            none.alias("hits"),
        ),
    )
    per_class = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("support", "called", "hits")])
    )
    packed = F.struct("support", "called", "hits")
    if positive is None:
        chosen = F.min_by(packed, F.col("class"))
    else:
        chosen = F.max(F.when(F.col("class") == F.lit(positive), packed))
    wide = per_class.groupBy(*by).agg(
        F.count("*").alias("levels"),
        F.sum("support").alias("total"),
        F.sum("hits").alias("correct"),
        F.sum(F.col("support") * F.col("called")).alias("chance"),
        chosen.alias("one"),
        F.avg(F.try_divide("hits", "called")).alias("macro_precision"),
        F.avg(F.try_divide("hits", "support")).alias("macro_recall"),
    )
    levels = F.lit(n_levels) if n_levels is not None else F.col("levels")
    binary = (levels == 2) | F.lit(positive is not None)
    precision_ = F.when(binary, F.try_divide("one.hits", "one.called")).otherwise(
        F.col("macro_precision")
    )
    recall_ = F.when(binary, F.try_divide("one.hits", "one.support")).otherwise(
        F.col("macro_recall")
    )
    observed = F.col("correct") / F.col("total")
    expected = F.col("chance") / (F.col("total") * F.col("total"))
    parts = {
        "accuracy": observed,
        "precision": precision_,
        "recall": recall_,
        "f_meas": F.try_divide(2 * precision_ * recall_, precision_ + recall_),
        "kappa": F.try_divide(observed - expected, 1 - expected),
    }
    return _long(wide, by, [(n, STANDARD, parts[n]) for n in names])


def accuracy(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    return _class_metrics(df, y, yhat, by, ["accuracy"])


def precision(
    df: DataFrame, y: str, yhat: str, positive: object = None, by: Sequence[str] = ()
) -> DataFrame:
    return _class_metrics(df, y, yhat, by, ["precision"], positive)


def recall(
    df: DataFrame, y: str, yhat: str, positive: object = None, by: Sequence[str] = ()
) -> DataFrame:
    return _class_metrics(df, y, yhat, by, ["recall"], positive)


def f_meas(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Harmonic mean of the precision and recall above (macro P and macro R)."""
    return _class_metrics(df, y, yhat, by, ["f_meas"])


def kappa(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    return _class_metrics(df, y, yhat, by, ["kappa"])


# -- ranking ------------------------------------------------------------------


def _rank_sum(
    scored: DataFrame, groups: Sequence[str], max_group_rows: int, group_rows: int | None
) -> DataFrame:
    """Share of (event, other) pairs ranked rightly, ties half, per group.

    ``scored`` has ``score`` and a boolean ``event``. Equal scores are collapsed before
    they are ordered.
    """
    steps = scored.groupBy(*groups, "score").agg(
        F.count_if("event").cast("double").alias("events"),
        F.count_if(~F.col("event")).cast("double").alias("others"),
    )
    placed = prefix_sums(
        steps, groups, "score", ["others"], max_group_rows=max_group_rows, group_rows=group_rows
    )
    return placed.groupBy(*groups).agg(
        F.try_divide(
            F.sum(F.col("events") * (F.col("others_before") + F.col("others") / 2)),
            F.sum("events") * F.sum("others"),
        ).alias("auc")
    )


def roc_auc(
    df: DataFrame,
    y: str,
    score: str,
    event: object,
    by: Sequence[str] = (),
    *,
    max_group_rows: int = MAX_GROUP_ROWS,
    group_rows: int | None = None,
) -> DataFrame:
    """Area under the ROC curve; ``score`` must be the probability of ``event``."""
    scored = _complete(df, y, score).select(
        *by, column(score).cast("double").alias("score"), (column(y) == F.lit(event)).alias("event")
    )
    wide = _rank_sum(scored, by, max_group_rows, group_rows)
    return _long(wide, by, [("roc_auc", "binary", F.col("auc"))])


def roc_auc_hand_till(
    df: DataFrame,
    y: str,
    probability: str,
    levels: Sequence[object],
    by: Sequence[str] = (),
    *,
    max_group_rows: int = MAX_GROUP_ROWS,
    group_rows: int | None = None,
) -> DataFrame:
    """Hand and Till (2001): mean AUC over ordered class pairs.

    ``probability`` is an array in the order of ``levels``. Each of the K scores orders all
    rows once: from the counts of (score, class) and one running count of the score's own
    class, the areas against all other classes follow, one sum per class. Rows are neither
    paired nor written per pair of classes.
    """
    known = F.array(*[F.lit(v) for v in levels])
    own = F.array_position(known, column(y)) - 1
    scores = F.array(
        *[F.struct(F.lit(i).alias("i"), F.get("_p", F.lit(i)).alias("score")) for i in range(len(levels))]
    )
    scored = (
        _complete(df, y)
        .select(*by, own.cast("int").alias("j"), column(probability).alias("_p"))
        .filter("j >= 0 AND _p IS NOT NULL")
        .select(*by, "j", F.inline(scores))
    )
    # events below a row, ties half: what the events above it leave of all pairs
    below = F.col("events_before") + F.col("events") / 2
    options = {"max_group_rows": max_group_rows, "group_rows": group_rows}
    if len(levels) <= FEW_LEVELS:
        # a count per class next to each score: one aggregation, and sums of columns
        own_count = F.get(F.array(*[f"n{j}" for j in range(len(levels))]), F.col("i"))
        steps = (
            scored.groupBy(*by, "i", "score")
            .agg(*[F.count_if(F.col("j") == j).cast("double").alias(f"n{j}") for j in range(len(levels))])
            .withColumn("events", own_count)
        )
        placed = prefix_sums(steps, [*by, "i"], "score", ["events"], **options).withColumn("_below", below)
        wide = placed.groupBy(*by, "i").agg(
            *[F.sum(f"n{j}").alias(f"n{j}") for j in range(len(levels))],
            *[F.sum(F.col(f"n{j}") * F.col("_below")).alias(f"l{j}") for j in range(len(levels))],
        )
        sides = [
            F.struct(F.lit(j).alias("j"), F.col(f"n{j}").alias("n"), F.col(f"l{j}").alias("lost"))
            for j in range(len(levels))
        ]
        sums = wide.select(*by, "i", F.inline(F.array(*sides))).filter("n > 0")
    else:
        counts = scored.groupBy(*by, "i", "score", "j").agg(F.count("*").cast("double").alias("n"))
        # a score has a row with at most K classes in it
        steps = counts.groupBy(*by, "i", "score").agg(
            F.coalesce(F.sum(F.when(F.col("j") == F.col("i"), F.col("n"))), F.lit(0.0)).alias("events"),
            F.collect_list(F.struct("j", "n")).alias("classes"),
        )
        placed = prefix_sums(steps, [*by, "i"], "score", ["events"], **options)
        sums = (
            placed.select(*by, "i", below.alias("below"), F.inline("classes"))
            .groupBy(*by, "i", "j")
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("below")).alias("lost"))
        )
    # at most K rows share a score; a class without rows has no areas
    own_events = F.max(F.when(F.col("i") == F.col("j"), F.col("n"))).over(Window.partitionBy(*by, "i"))
    each = sums.withColumn("events", own_events).filter("i <> j")
    area = 1 - F.col("lost") / (F.col("n") * F.col("events"))
    wide = each.groupBy(*by).agg(F.avg(area).alias("auc"))
    return _long(wide, by, [("roc_auc", "multiclass", F.col("auc"))])


def metric_set(
    df: DataFrame,
    y: str,
    yhat: str,
    task_type: str,
    *,
    probability: str | None = None,
    levels: Sequence[object] | None = None,
    by: Sequence[str] = (),
    extra: bool = False,
    group_rows: int | None = None,
) -> DataFrame:
    """The standard metrics of a task; ``extra`` adds mape or kappa.

    With ``probability`` (array in ``levels`` order) class tasks also get the AUC. The
    event of a binary AUC is the second level, whose probability is the score.
    ``group_rows`` is a known bound on the rows per ``by`` group.
    """
    if task_type == REGRESSION:
        names = ["rmse", "rsq", "mae"] + (["mape"] if extra else [])
        return _regression(df, y, yhat, by, names)
    names = ["accuracy", "precision", "recall", "f_meas"] + (["kappa"] if extra else [])
    binary = levels is not None and len(levels) == 2
    out = _class_metrics(
        df, y, yhat, by, names,
        positive=levels[0] if binary else None,
        n_levels=len(levels) if levels is not None else None,
    )
    if probability is None or levels is None or len(levels) < 2:
        return out
    if binary:
        scored = df.withColumn("_score", F.get(column(probability), F.lit(1)))
        return out.unionByName(roc_auc(scored, y, "_score", levels[1], by, group_rows=group_rows))
    return out.unionByName(roc_auc_hand_till(df, y, probability, levels, by, group_rows=group_rows))
