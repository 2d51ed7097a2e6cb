"""Deterministic row hashes: the only source of randomness in the package.

A split, fold or sample is a function of a row's key and a seed, so a task that
is retried on another executor puts every row exactly where it was before, and
any engine that has md5 can reproduce the choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlscout.kinds import NESTED, column, kind_of

_HEX_DIGITS = 13  # 52 bits: a double holds every value exactly
HASH_RANGE = 16**_HEX_DIGITS


def row_hash(keys: Sequence[str], seed: int) -> Column:
    """52-bit hash of the key columns and the seed, as a non-negative long."""
    parts = [F.coalesce(column(k).cast("string"), F.lit("\x00")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("bigint")


def content_hash(df: DataFrame) -> Column:
    """Hash of the whole row: breaks ties between rows that share a key, so that a
    retried task orders them as before. Rows that still tie are copies."""
    unhashable = (T.MapType, T.VariantType)
    names = [f.name for f in df.schema if not isinstance(f.dataType, unhashable)]
    return F.xxhash64(*[column(c) for c in names])


def key_columns(df: DataFrame, key: str | Sequence[str] | None) -> list[str]:
    """The caller's key, or every non-nested column (identical rows then hash alike)."""
    if key is None:
        return [f.name for f in df.schema if kind_of(f.dataType) != NESTED]
    return [key] if isinstance(key, str) else list(key)
