"""Column kinds and the missing / finite predicates every operator shares.

A value is *missing* when it is NULL or, for floating columns, NaN. Infinite
values are not missing; they are a separate state that some statistics skip.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
BOOLEAN = "boolean"
TEMPORAL = "temporal"
NESTED = "nested"
OTHER = "other"

_INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING_TYPES = (T.FloatType, T.DoubleType)
_TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, _INTEGRAL_TYPES)


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, _FLOATING_TYPES)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, _INTEGRAL_TYPES + _FLOATING_TYPES + (T.DecimalType,)):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, _TEMPORAL_TYPES):
        return TEMPORAL
    # vectors and other user-defined types are nested as well
    if isinstance(data_type, _NESTED_TYPES + (T.UserDefinedType,)):
        return NESTED
    return OTHER


def columns_of(df: DataFrame, *kinds: str, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the columns of the given kinds, in schema order."""
    skip = set(exclude)
    return [f.name for f in df.schema if kind_of(f.dataType) in kinds and f.name not in skip]


def column(name: str) -> Column:
    """A column reference that survives dots, blanks and backticks in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing(df: DataFrame, name: str) -> Column:
    ref = column(name)
    if is_floating(df.schema[name].dataType):
        return ref.isNull() | F.isnan(ref)
    return ref.isNull()


def infinite(df: DataFrame, name: str) -> Column:
    """True for +Inf / -Inf; always false for non-floating columns and missing values."""
    if is_floating(df.schema[name].dataType):
        return F.coalesce(F.abs(column(name)) == F.lit(float("inf")), F.lit(False))
    return F.lit(False)


def finite_double(df: DataFrame, name: str) -> Column:
    """The value as double, or NULL when it is missing or infinite."""
    value = column(name).cast("double")
    if is_floating(df.schema[name].dataType):
        return F.when(~missing(df, name) & ~infinite(df, name), value)
    return value


def present_double(df: DataFrame, name: str) -> Column:
    """The value as double, or NULL when it is missing; infinities stay."""
    value = column(name).cast("double")
    if is_floating(df.schema[name].dataType):
        return F.when(~missing(df, name), value)
    return value


def drop_nested(df: DataFrame) -> tuple[DataFrame, list[str]]:
    nested = columns_of(df, NESTED)
    return df.drop(*nested), nested
