"""Ranked learning methods for a task."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlscout.operators.task import CLASSIFICATION, REGRESSION, Task, needs_regularization

SECONDS_PER_MODEL = 30  # rough figure shown to users, independent of the data

# Engine -> display name; other engines show as they are.
DISPLAY_NAMES = {
    "glmnet": "Lasso/Ridge Regression",
    "ranger": "Random Forest",
    "xgboost": "XGBoost",
    "kernlab": "Support Vector Machine",
    "kknn": "K-Nearest Neighbors",
    "rpart": "Decision Tree",
    "naivebayes": "Naive Bayes",
}

# Method name shown in the recommendation table.
METHOD_NAMES = {
    "ranger": "Random Forest",
    "xgboost": "XGBoost",
    "kernlab": "Support Vector Machine (SVM)",
    "naivebayes": "Naive Bayes",
    "kknn": "K-Nearest Neighbors (KNN)",
    "rpart": "Decision Tree",
}
LASSO_NAMES = {
    "continuous": "Linear Regression (with Lasso)",
    "binary": "Logistic Regression (with Lasso)",
    "multiclass": "Multinomial Regression (with Lasso)",
}

# Engine -> tasks it can learn; engines not listed are allowed.
COMPATIBILITY = {
    "glmnet": [REGRESSION, CLASSIFICATION],
    "ranger": [REGRESSION, CLASSIFICATION],
    "xgboost": [REGRESSION, CLASSIFICATION],
    "kernlab": [REGRESSION, CLASSIFICATION],
    "kknn": [REGRESSION, CLASSIFICATION],
    "rpart": [REGRESSION, CLASSIFICATION],
    "naivebayes": [CLASSIFICATION],
    "lm": [REGRESSION],
    "glm": [CLASSIFICATION],
}

# Short reason and caveat per engine.
NOTES = {
    "glmnet": ("sparse linear baseline; unused features drop out", "sees linear effects only"),
    "ranger": ("bagged trees; robust and rarely needs tuning", "many trees are hard to read"),
    "xgboost": ("boosted trees; usually among the most accurate", "sensitive to its settings"),
    "kernlab": ("smooth non-linear boundary", "needs scaled features; slow on many rows"),
    "naivebayes": ("one pass over the data; handles many classes", "assumes independent features"),
    "kknn": ("no model assumptions at all", "costly predictions; scale matters"),
    "rpart": ("a single tree anyone can read", "overfits easily; use as a baseline"),
}

RECOMMENDATION_COLUMNS = ["method", "priority", "rationale", "engine", "considerations"]


def _priorities(task: Task) -> list[tuple[str, int]]:
    """Engines in listing order with their priority (1 = try first)."""
    n, p = task.n_samples, task.n_predictors
    boost = 1 if n > 1000 else 2
    neighbours = 2 if n < 1000 else 3
    if task.task_type == REGRESSION:
        return [
            ("glmnet", 1 if needs_regularization(task) else 2),
            ("ranger", 1),
            ("xgboost", boost),
            ("kernlab", 1 if n < 5000 and p < 50 else 3),
            ("kknn", neighbours),
            ("rpart", 3),
        ]
    if task.task_subtype == "binary":
        return [
            ("glmnet", 1),
            ("ranger", 1),
            ("xgboost", boost),
            ("kernlab", 1 if n < 5000 else 3),
            ("naivebayes", 2),
            ("kknn", neighbours),
            ("rpart", 3),
        ]
    return [
        ("glmnet", 2),
        ("ranger", 1),
        ("xgboost", 1),
        ("naivebayes", 2),
        ("kknn", neighbours),
        ("rpart", 3),
    ]


def recommend(spark: SparkSession, task: Task) -> DataFrame:
    """Compatible methods by priority, ties in listing order."""
    names = METHOD_NAMES | {"glmnet": LASSO_NAMES[task.task_subtype]}
    rows = [
        (seq, names[engine], priority, NOTES[engine][0], engine, NOTES[engine][1])
        for seq, (engine, priority) in enumerate(_priorities(task))
    ]
    table = spark.createDataFrame(
        rows,
        "seq int, method string, priority int, rationale string, engine string, "
        "considerations string",
    )
    return (
        filter_compatible(table, task.task_type)
        .orderBy("priority", "seq")
        .select(*RECOMMENDATION_COLUMNS)
    )


def is_compatible(engine: str, task_type: str) -> bool:
    if engine not in COMPATIBILITY:
        warnings.warn(f"unknown engine '{engine}' is assumed to fit the task", stacklevel=2)
        return True
    return task_type in COMPATIBILITY[engine]


def filter_compatible(methods: DataFrame, task_type: str) -> DataFrame:
    """Keep rows whose ``engine`` can learn the task; unknown engines are kept."""
    refused = [e for e, tasks in COMPATIBILITY.items() if task_type not in tasks]
    return methods.filter(F.col("engine").isNull() | ~F.col("engine").isin(refused))


def display_name(engine: Column) -> Column:
    name = engine
    for key, shown in DISPLAY_NAMES.items():
        name = F.when(engine == key, F.lit(shown)).otherwise(name)
    return name


def default_selection(recommendations: DataFrame) -> DataFrame:
    """The first three recommendations and a rough training time for each."""
    return recommendations.limit(3).withColumn("estimated_seconds", F.lit(SECONDS_PER_MODEL))
