"""Whole-table cleaning: missing values, outliers, class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlscout.functions.counts import modes
from mlscout.functions.hashing import content_hash, key_columns, row_hash
from mlscout.functions.ordering import (
    MAX_GROUP_ROWS,
    exact_quantiles,
    lowest_per_group,
    mark_lowest,
    replicate,
)
from mlscout.kinds import (
    CATEGORICAL,
    NUMERIC,
    column,
    columns_of,
    drop_nested,
    is_integral,
    missing,
    present_double,
)
from mlscout.operators.profile import iqr_fences
from mlscout.sources.audits import guard_trainable

MISSING_STRATEGIES = ["impute", "remove_rows", "remove_cols", "keep"]
OUTLIER_STRATEGIES = ["keep", "cap_iqr"]
BALANCE_STRATEGIES = ["none", "oversample", "undersample"]
MAX_MISSING_SHARE = 0.5
MAX_BROADCAST_CLASSES = 100_000


def _missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    row = df.agg(
        F.count("*"), *[F.count_if(missing(df, c)) for c in df.columns]
    ).first()
    return row[0], dict(zip(df.columns, row[1:]))


def impute(df: DataFrame) -> DataFrame:
    """Median into numeric columns, most frequent value into text columns.

    The target is not spared. An integral column whose median is fractional becomes
    double; other columns keep their type.
    """
    _, gaps = _missing_counts(df)
    numeric = [c for c in columns_of(df, NUMERIC) if gaps[c]]
    text = [c for c in columns_of(df, CATEGORICAL) if gaps[c]]
    changes = {}
    for c, (median,) in exact_quantiles(df, numeric, [0.5], keep_infinite=True).items():
        if median is None:
            continue
        data_type = df.schema[c].dataType
        if is_integral(data_type) and not float(median).is_integer():
            changes[c] = F.coalesce(present_double(df, c), F.lit(median))
        else:
            fill = F.lit(median).cast(data_type)
            changes[c] = F.when(missing(df, c), fill).otherwise(column(c))
    for c, mode in modes(df, text).items():
        if mode is not None:
            changes[c] = F.coalesce(column(c), F.lit(mode))
    return df.withColumns(changes) if changes else df


def drop_missing_rows(df: DataFrame) -> DataFrame:
    """Keep complete rows (NaN counts as missing)."""
    return df.dropna("any")


def drop_missing_columns(
    df: DataFrame, target: str, max_share: float = MAX_MISSING_SHARE
) -> DataFrame:
    """Drop columns whose missing share is above ``max_share``, never the target."""
    rows, gaps = _missing_counts(df)
    lost = [c for c in df.columns if c != target and rows and gaps[c] / rows > max_share]
    return df.drop(*lost)


def cap_iqr(df: DataFrame, target: str | None = None) -> DataFrame:
    """Cap numeric columns at their Tukey fences as double; missing values stay missing."""
    names = columns_of(df, NUMERIC, exclude=[target] if target else [])
    changes = {}
    for c, fence in iqr_fences(df, names).items():
        if fence is None:
            continue
        low, high = fence
        value = present_double(df, c)
        changes[c] = F.when(
            value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low))
        )
    return df.withColumns(changes) if changes else df


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per class in ``_n``; rows without a class are not counted."""
    return df.filter(~missing(df, target)).groupBy(column(target)).agg(F.count("*").alias("_n"))


def oversample(
    df: DataFrame,
    target: str,
    seed: int = 123,
    key: str | Sequence[str] | None = None,
    *,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Repeat rows until every class is as large as the largest one.

    A class of n rows gets ``max div n`` copies of every row and one more copy of the
    ``max mod n`` rows with the lowest key hash. Rows without a class are dropped.
    """
    counts = class_counts(df, target)
    largest, smallest, n_classes = counts.agg(F.max("_n"), F.min("_n"), F.count("*")).first()
    if largest is None:
        return df.limit(0)
    quotas = counts.withColumn("_k", F.lit(largest) % F.col("_n"))
    flagged = mark_lowest(
        df, target, quotas, key_columns(df, key), seed, "_more", max_group_rows=max_group_rows
    )
    sizes = counts.withColumn("_base", (F.lit(largest) / F.col("_n")).cast("bigint")).drop("_n")
    if n_classes <= MAX_BROADCAST_CLASSES:
        sizes = F.broadcast(sizes)  # a hot class must not be shuffled to one task
    repeated = replicate(
        flagged.join(sizes, target),
        F.col("_base") + F.col("_more").cast("bigint"),
        largest // smallest + 1,
    )
    return repeated.select(*[column(c) for c in df.columns])


def undersample(
    df: DataFrame,
    target: str,
    seed: int = 123,
    key: str | Sequence[str] | None = None,
    *,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Keep as many rows of every class as the smallest has, those with the lowest hash."""
    counts = class_counts(df, target)
    smallest = counts.agg(F.min("_n")).first()[0]
    if smallest is None:
        return df.limit(0)
    quotas = counts.withColumn("_k", F.lit(smallest))
    return lowest_per_group(
        df, target, quotas, key_columns(df, key), seed, max_group_rows=max_group_rows
    )


def shuffle(df: DataFrame, seed: int = 123, key: str | Sequence[str] | None = None) -> DataFrame:
    """Rows in hash order. Spark learners do not need it; for exports that do."""
    keys = key_columns(df, key)
    return df.orderBy(row_hash(keys, seed), *[column(k) for k in keys], content_hash(df))


def clean(
    df: DataFrame,
    target: str,
    missing_strategy: str = "impute",
    outlier_strategy: str = "keep",
    balance_strategy: str = "none",
    *,
    task_type: str = "classification",
    seed: int = 123,
    key: str | Sequence[str] | None = None,
) -> DataFrame:
    """Missing values, then outliers, then class balance; fails if too little is left.

    For exploration: the statistics come from all rows. ``train`` fits its own recipe
    on training rows and balances training rows only.
    """
    for value, known in (
        (missing_strategy, MISSING_STRATEGIES),
        (outlier_strategy, OUTLIER_STRATEGIES),
        (balance_strategy, BALANCE_STRATEGIES),
    ):
        if value not in known:
            raise ValueError(f"unknown strategy '{value}'; use one of {', '.join(known)}")
    out, _ = drop_nested(df)
    if missing_strategy == "impute":
        out = impute(out)
    elif missing_strategy == "remove_rows":
        out = drop_missing_rows(out)
    elif missing_strategy == "remove_cols":
        out = drop_missing_columns(out, target)
    if outlier_strategy == "cap_iqr":
        out = cap_iqr(out, target)
    if task_type == "classification":
        if balance_strategy == "oversample":
            out = oversample(out, target, seed, key)
        elif balance_strategy == "undersample":
            out = undersample(out, target, seed, key)
    guard_trainable(out, target)
    return out
