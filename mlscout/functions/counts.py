"""Value counts over many columns at once: one shuffle on (column, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mlscout.kinds import column


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(position, column, value, n)`` over string forms; NULL is a value of its own.

    ``by`` columns stand in front and part the counts.

    Hot values are combined on the map side, so a value held by a third of all rows
    costs one row per map task.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                column(c).cast("string").alias("value"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return (
        df.select(*map(column, by), F.inline(entries))
        .groupBy(*map(column, by), "position", "column", "value")
        .agg(F.count("*").alias("n"))
    )


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent non-missing values per column, ties alphabetical.

    ``row_number() <= k`` is pushed below the shuffle by the window group limit.
    """
    # missing values are ranked last and dropped after the ranking: a filter before it would
    # reach the scan and keep the shuffled counts from being shared with other uses
    window = Window.partitionBy("position", "column").orderBy(
        F.col("value").isNull(), F.desc("n"), "value"
    )
    return (
        counts.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= k)
        .filter("value IS NOT NULL")
    )


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-missing value per column (tie: alphabetical first)."""
    if not columns:
        return {}
    best = (
        value_counts(df, columns)
        .filter("value IS NOT NULL")
        .groupBy("column")
        .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    )
    found = {r["column"]: r["value"] for r in best.collect()}
    return {c: found.get(c) for c in columns}
