"""Inputs shared by the queries and their SQL: same expressions on both sides.

The given tables hold no missing values, so a key rule takes some away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlscout.kinds import is_floating

LINES = [
    "l_orderkey",
    "l_linenumber",
    "l_quantity",
    "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice",
    "CASE WHEN l_orderkey % 5 < 3 THEN NULL ELSE l_discount END AS l_discount",
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax",
    "100.0e0 + l_tax AS steady",
    "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "l_linestatus",
    "CAST(l_suppkey AS STRING) AS supplier",
]
LINE_NUMERIC = [
    "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "steady",
]
LINE_TEXT = ["l_returnflag", "l_linestatus", "supplier"]
LINE_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "steady",
    "l_returnflag", "l_linestatus", "supplier",
]

EVENTS = [
    "event_id",
    "CASE WHEN event_id % 8 = 0 THEN NULL ELSE value END AS value",
    "user_id",
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type",
]

# predictions made by a fixed rule
PRICES = [
    "l_orderkey",
    "l_linenumber",
    "l_extendedprice AS y",
    "2100.0e0 * l_quantity * (1 - l_discount) AS yhat",
]
FLAGS = [
    "event_id",
    "CASE WHEN event_type IN ('error', 'purchase') THEN 'bad' ELSE 'good' END AS y",
    "CASE WHEN value > 40 THEN 'bad' ELSE 'good' END AS yhat",
    "1 / (1 + value / 40) AS p_good",
]
KINDS = [
    "event_id",
    "event_type AS y",
    "CASE WHEN value < 10 THEN 'click' WHEN value < 30 THEN 'error' WHEN value < 60 THEN 'view' "
    "ELSE 'purchase' END AS yhat",
]
KIND_LEVELS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*LINES)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*EVENTS)


def prices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*PRICES)


def flags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*FLAGS)


def kinds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*KINDS)


def cte(name: str, expressions: list[str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(expressions)} FROM {source})"


LINES_SQL = cte("t", LINES, "lineitem")
EVENTS_SQL = cte("t", EVENTS, "events")
PRICES_SQL = cte("t", PRICES, "lineitem")
FLAGS_SQL = cte("t", FLAGS, "events")
KINDS_SQL = cte("t", KINDS, "events")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, so that two engines agree on the last digits."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if is_floating(f.dataType) else f.name
            for f in df.schema
        ]
    )


def hash_sql(key: str, seed: int) -> str:
    """The row hash of one key column in DuckDB."""
    return f"('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 13))::BIGINT"


def hash2_sql(key1: str, key2: str, seed: int) -> str:
    text = f"'{seed}|' || CAST({key1} AS VARCHAR) || '|' || CAST({key2} AS VARCHAR)"
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


def text_sql(value: str, digits: int) -> str:
    """Number to text without trailing zeros."""
    shown = f"printf('%.{digits}f', round({value}, {digits}))"
    return rf"regexp_replace(regexp_replace({shown}, '0+$', ''), '\.$', '')"
