"""Exports. Text that a spreadsheet would run as a formula is neutralised first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from mlscout.functions.text import neutralise_formula
from mlscout.kinds import CATEGORICAL, column, columns_of


def sanitize(df: DataFrame) -> DataFrame:
    """Neutralise formulas in every text column; other columns are untouched."""
    text = set(columns_of(df, CATEGORICAL))
    return df.select(
        *[neutralise_formula(column(c)).alias(c) if c in text else column(c) for c in df.columns]
    )


def _write_csv(df: DataFrame, path: str) -> None:
    sanitize(df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_cleaned(df: DataFrame, path: str) -> None:
    """The cleaned table as a folder of CSV parts, one per partition."""
    _write_csv(df, path)


def write_predictions(
    predictions: DataFrame, path: str, levels: Sequence[str] | None = None
) -> None:
    """A prediction table as CSV; the probability array becomes one column per level."""
    flat = predictions
    if "probability" in predictions.columns:
        flat = predictions.drop("probability")
        if levels:
            flat = predictions.select(
                *[column(c) for c in predictions.columns if c != "probability"],
                *[
                    predictions["probability"][i].alias(f"pred_{level}")
                    for i, level in enumerate(levels)
                ],
            )
    _write_csv(flat, path)
