"""Score a new labelled table with a fitted model and compare it with the test rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlscout.kinds import column
from mlscout.operators.diagnostics import drift_classification, drift_regression
from mlscout.operators.metrics import metric_set
from mlscout.operators.task import REGRESSION
from mlscout.plans.train import TrainResult
from mlscout.sources.audits import check_schema


@dataclass
class Validation:
    predictions: DataFrame
    metrics: DataFrame
    drift: DataFrame


def validate(result: TrainResult, new: DataFrame) -> Validation:
    """The fitted recipe is applied to the raw new rows.

    Missing training columns raise, extra ones are ignored. Classes not seen in training
    become missing and are left out of the metrics.
    """
    check_schema(result.trained_schema, new, result.target, strict=True)
    rows = new.select(*[column(c) for c in result.trained_schema.names])
    if result.task_type != REGRESSION:
        seen = column(result.target).isin(result.model.levels)
        rows = rows.withColumn(result.target, F.when(seen, column(result.target)))
    kept = [*dict.fromkeys([*result.model.recipe.ids, result.target])]
    predictions = result.model.predict(rows, kept)
    metrics = metric_set(
        predictions, result.target, "prediction", result.task_type,
        levels=result.model.levels or None, extra=result.task_type != REGRESSION,
    )
    drift = drift_regression if result.task_type == REGRESSION else drift_classification
    return Validation(predictions, metrics, drift(result.test_metrics, metrics))
