"""Which learning task a target column calls for."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlscout.kinds import CATEGORICAL, NUMERIC, TEMPORAL, column, kind_of, missing
from mlscout.sources.audits import audit_target

CLASSIFICATION = "classification"
REGRESSION = "regression"

# Task rule thresholds.
MAX_DISCRETE_LEVELS = 20
SURE_UNIQUE_RATIO = 0.05
LIKELY_UNIQUE_RATIO = 0.10
NOTED_DISCRETE_LEVELS = 50
SEVERE_IMBALANCE = 0.05
MODERATE_IMBALANCE = 0.20
ROWS_PER_PREDICTOR = {CLASSIFICATION: 10, REGRESSION: 20}
MIN_ROWS = 100
REGULARISE_BELOW_RATIO = 20
REGULARISE_ABOVE_PREDICTORS = 50

TASK_SCHEMA = (
    "target string, target_type string, n_unique bigint, task_type string, "
    "task_subtype string, confidence string, note string, imbalance string, "
    "min_class_share double, n_samples bigint, n_predictors int, "
    "sample_to_feature_ratio double, min_recommended bigint, small_sample boolean"
)


@dataclass
class Task:
    target: str
    target_type: str
    n_unique: int
    task_type: str
    task_subtype: str
    confidence: str
    note: str | None
    imbalance: str | None
    min_class_share: float | None
    n_samples: int
    n_predictors: int
    sample_to_feature_ratio: float | None
    min_recommended: int
    small_sample: bool

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], TASK_SCHEMA)


def detect_task(df: DataFrame, target: str) -> Task:
    """Classification or regression, from one count per distinct target value."""
    audit_target(df, target)
    data_type = df.schema[target].dataType
    kind = kind_of(data_type)
    value = column(target)
    present = F.col("value").isNotNull()
    whole = F.lit(True)
    if kind == NUMERIC:
        number = F.col("value").cast("double")
        endless = F.abs(number) == float("inf")
        whole = F.coalesce(endless | (number % 1 == 0), F.lit(True))
    counts = (
        df.select(F.when(~missing(df, target), value).alias("value"))
        .groupBy("value")
        .agg(F.count("*").alias("n"))
    )
    stats = counts.agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(present, F.col("n"))).alias("observed"),
        F.count("value").alias("unique"),
        F.min(F.when(present, F.col("n"))).alias("rarest"),
        F.min(whole).alias("discrete"),
    ).first()

    unique = stats.unique
    if unique == 0:
        raise ValueError(f"target '{target}' is entirely missing")
    if unique < 2:
        raise ValueError(f"target '{target}' has only one distinct value; nothing to learn")
    if kind == TEMPORAL:
        raise ValueError(
            f"target '{target}' is a date or time: turn it into a number (days since a date) "
            "or into parts (year, month, weekday), or use a forecasting method"
        )
    if kind not in (NUMERIC, CATEGORICAL):
        raise ValueError(
            f"target '{target}' must be numeric or text, not {data_type.simpleString()}; "
            "cast it first"
        )

    confidence, note = "high", None
    if kind == CATEGORICAL or unique <= 2:
        task_type = CLASSIFICATION
        subtype = "binary" if unique == 2 else "multiclass"
    else:
        ratio = unique / stats.observed
        few = stats.discrete and unique <= MAX_DISCRETE_LEVELS
        if few and ratio < LIKELY_UNIQUE_RATIO:
            task_type, subtype = CLASSIFICATION, "multiclass"
            note = f"{unique} discrete levels"
            if ratio >= SURE_UNIQUE_RATIO:
                confidence = "medium"
                note = f"{unique} discrete levels; if they are ordered, consider regression"
                warnings.warn(f"target '{target}': {note}", stacklevel=2)
        else:
            task_type, subtype = REGRESSION, "continuous"
            if stats.discrete and unique < NOTED_DISCRETE_LEVELS:
                note = f"{unique} discrete values treated as regression"

    imbalance, share = None, None
    if task_type == CLASSIFICATION:
        share = stats.rarest / stats.observed
        if share < SEVERE_IMBALANCE:
            imbalance = "severe"
            warnings.warn(
                f"target '{target}': the rarest class holds {share:.1%} of the rows", stacklevel=2
            )
        elif share < MODERATE_IMBALANCE:
            imbalance = "moderate"

    predictors = len(df.columns) - 1
    needed = max(predictors * ROWS_PER_PREDICTOR[task_type], MIN_ROWS)
    small = stats.rows < needed
    if small:
        warnings.warn(
            f"{stats.rows} rows for {predictors} predictors; at least {needed} are advised",
            stacklevel=2,
        )
    return Task(
        target=target,
        target_type=data_type.simpleString(),
        n_unique=unique,
        task_type=task_type,
        task_subtype=subtype,
        confidence=confidence,
        note=note,
        imbalance=imbalance,
        min_class_share=share,
        n_samples=stats.rows,
        n_predictors=predictors,
        sample_to_feature_ratio=stats.rows / predictors if predictors else None,
        min_recommended=needed,
        small_sample=small,
    )


def needs_regularization(task: Task) -> bool:
    ratio = task.sample_to_feature_ratio
    return (ratio is not None and ratio < REGULARISE_BELOW_RATIO) or (
        task.n_predictors > REGULARISE_ABOVE_PREDICTORS
    )
