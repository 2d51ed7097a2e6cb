"""Checks on files, names, sizes and schemas before any work is done."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions a file may have, and those whose magic bytes are expected.
ALLOWED_EXTENSIONS = [
    "csv", "tsv", "txt", "xlsx", "xls", "rds", "rdata", "rda", "sas7bdat", "xpt", "dta", "sav",
]
ZIPPED_EXTENSIONS = ["xlsx", "xls"]
GZIPPED_EXTENSIONS = ["rds", "rdata", "rda"]
GZIP_MAGIC = "1F8B"
ZIP_MAGIC = "504B"

# Name rules.
NAME_PATTERN = "^[a-zA-Z][a-zA-Z0-9_]*$"
SUSPICIOUS_IN_COLUMN = [
    "system", "eval", "parse", "exec", "shell", "cmd", "library", "require", "source", "load",
]
SUSPICIOUS_IN_TARGET = ["system", "eval", "parse", "exec", "shell", "cmd"]
RESERVED_WORDS = [
    "if", "else", "repeat", "while", "function", "for", "in", "next", "break", "TRUE", "FALSE",
    "NULL", "Inf", "NaN", "NA", "NA_integer_", "NA_real_", "NA_complex_", "NA_character_",
]
MAX_NAME_LENGTH = 100

MIN_TRAINING_ROWS = 10
MIN_TRAINING_COLUMNS = 2


def audit_files(
    spark: SparkSession,
    path: str,
    max_mb: float | None = None,
    allowed: Sequence[str] = tuple(ALLOWED_EXTENSIONS),
) -> DataFrame:
    """Verdict per file of a folder or glob: ok, too_large, bad_format, compressed, archive.

    Size and name come from the file listing. Only the first bytes of a small enough
    file are looked at, so a huge file is refused without being loaded.
    """
    listed = spark.read.format("binaryFile").load(path).withColumnRenamed("length", "bytes")
    limit = (1 << 62) if max_mb is None else int(max_mb * 1024 * 1024)
    sizes = listed.select("path", "bytes", F.lit(None).cast("string").alias("magic"))
    heads = listed.filter(F.col("bytes") <= limit).select(
        "path", "bytes", F.hex(F.substring(F.col("content"), 1, 2)).alias("magic")
    )
    rows = sizes.filter(F.col("bytes") > limit).unionByName(heads)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    verdict = (
        F.when(F.col("bytes") > limit, "too_large")
        .when(~F.col("ext").isin(list(allowed)), "bad_format")
        .when((F.col("magic") == GZIP_MAGIC) & ~F.col("ext").isin(GZIPPED_EXTENSIONS), "compressed")
        .when((F.col("magic") == ZIP_MAGIC) & ~F.col("ext").isin(ZIPPED_EXTENSIONS), "archive")
        .otherwise("ok")
    )
    return rows.withColumn("ext", ext).select(
        "path", "ext", "bytes", verdict.alias("verdict")
    )


def audit_columns(df: DataFrame, strict: bool = False) -> DataFrame:
    """Name-rule violations ``(position, column, rule, detail)``; ``strict`` raises instead.

    Rules in order: pattern, suspicious substring, reserved word, length. A column can
    break several rules.
    """
    found = []
    for i, name in enumerate(df.columns):
        if not re.match(NAME_PATTERN, name):
            found.append((i, name, "pattern", "letters, digits and _ only, letter first"))
        for word in SUSPICIOUS_IN_COLUMN:
            if word in name.lower():
                found.append((i, name, "suspicious", word))
        if name in RESERVED_WORDS:
            found.append((i, name, "reserved", name))
        if len(name) > MAX_NAME_LENGTH:
            found.append((i, name, "length", str(len(name))))
    if strict and found:
        order = ["pattern", "suspicious", "reserved", "length"]
        _, name, rule, detail = min(found, key=lambda f: order.index(f[2]))
        raise ValueError(f"column name '{name}' breaks rule '{rule}' ({detail})")
    return df.sparkSession.createDataFrame(
        found, "position int, column string, rule string, detail string"
    )


def audit_target(df: DataFrame, target: str) -> None:
    """Raise unless ``target`` is one existing, well-formed column name."""
    if target is None or (not isinstance(target, str) and _length(target) != 1):
        raise ValueError("the target must be a single column name")
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    if not isinstance(target, str):
        raise ValueError("the target column name must be a string")
    if not re.match(NAME_PATTERN, target):
        raise ValueError(f"target column name '{target}' has an invalid format")
    for word in SUSPICIOUS_IN_TARGET:
        if word in target.lower():
            raise ValueError(f"target column name '{target}' contains '{word}'")


def _length(value: object) -> int:
    return len(value) if isinstance(value, (list, tuple, set)) else 1


def audit_dimensions(
    df: DataFrame,
    max_rows: int | None = None,
    max_cols: int | None = None,
    max_cells: int | None = None,
) -> DataFrame:
    """``(limit, allowed, exceeded)`` per limit that is set; by default nothing is limited."""
    cols = len(df.columns)
    row_caps = []
    if max_rows is not None:
        row_caps.append(max_rows)
    if max_cells is not None and cols:
        row_caps.append(max_cells // cols)
    rows = df.count() if row_caps else 0
    checks = []
    if max_rows is not None:
        checks.append(("rows", max_rows, rows > max_rows))
    if max_cols is not None:
        checks.append(("cols", max_cols, cols > max_cols))
    if max_cells is not None:
        checks.append(("cells", max_cells, rows * cols > max_cells))
    return df.sparkSession.createDataFrame(
        checks, "limit string, allowed bigint, exceeded boolean"
    )


def guard_trainable(df: DataFrame, target: str) -> None:
    """Raise unless the target, ten rows and two columns are left."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' was removed by cleaning")
    if len(df.columns) < MIN_TRAINING_COLUMNS:
        raise ValueError("the target and at least one predictor must remain")
    left = df.limit(MIN_TRAINING_ROWS).count()
    if left < MIN_TRAINING_ROWS:
        raise ValueError(f"only {left} rows remain; at least {MIN_TRAINING_ROWS} are needed")


def check_schema(
    trained: T.StructType, df: DataFrame, target: str | None = None, strict: bool = False
) -> DataFrame:
    """``(column, status)`` with status ok, missing or extra; ``strict`` raises on missing."""
    expected = trained.names
    lost = [c for c in expected if c not in df.columns]
    if strict:
        if target is not None and target not in df.columns:
            raise ValueError(f"target column '{target}' not found in the new data")
        if lost:
            more = f" and {len(lost) - 5} more" if len(lost) > 5 else ""
            raise ValueError(f"new data lacks columns: {', '.join(lost[:5])}{more}")
    rows = [(c, "missing" if c in lost else "ok") for c in expected]
    rows += [(c, "extra") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column string, status string")
