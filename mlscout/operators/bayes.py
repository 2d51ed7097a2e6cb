"""Gaussian naive Bayes as plain aggregation: per-class moments, then one projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlscout.kinds import column, missing

VARIANCE_FLOOR = 1e-9


def _known(feature: str) -> Column:
    """The value, with NaN as missing."""
    value = column(feature).cast("double")
    return F.when(~F.isnan(value), value)


def gaussian_nb(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Per-class share and feature moments: ``(class, n, feature means and variances)``."""
    aggregates = [F.count("*").alias("n")]
    for i, f in enumerate(features):
        value = _known(f)
        aggregates += [F.avg(value).alias(f"mean_{i}"), F.var_pop(value).alias(f"var_{i}")]
    return (
        df.filter(~missing(df, target)).groupBy(column(target).alias("class")).agg(*aggregates)
    )


def gaussian_nb_predict(
    df: DataFrame, model: DataFrame, features: Sequence[str], prediction: str = "prediction"
) -> DataFrame:
    """Add the class with the highest posterior (tie: first class).

    A missing feature is left out of the posterior of every class.

    The model is one row per class, so it becomes literals of a projection.
    """
    rows = sorted(model.collect(), key=lambda r: r["class"])
    total = sum(r.n for r in rows)
    scored = []
    for r in rows:
        score = F.lit(math.log(r.n / total))
        for i, f in enumerate(features):
            if r[f"mean_{i}"] is None:
                continue  # the class has no value of it
            variance = max(r[f"var_{i}"], VARIANCE_FLOOR)
            gap = _known(f) - F.lit(r[f"mean_{i}"])
            term = F.lit(0.5 * math.log(2 * math.pi * variance)) + gap * gap / F.lit(2 * variance)
            score = score - F.coalesce(term, F.lit(0.0))
        scored.append(F.struct((-score).alias("cost"), F.lit(r["class"]).alias("class")))
    return df.withColumn(prediction, F.array_min(F.array(*scored))["class"])
