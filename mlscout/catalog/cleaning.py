"""Cleaning, balancing, splitting, sanitising and scalar functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlscout.catalog.fixtures import (
    LINE_COLUMNS, LINE_NUMERIC, LINE_TEXT, LINES_SQL, hash_sql, lines, rounded, table, text_sql,
)
from mlscout.functions.hashing import HASH_RANGE
from mlscout.functions.text import html_escape, number_text, pseudonymise
from mlscout.operators.clean import (
    cap_iqr, clean, drop_missing_columns, drop_missing_rows, impute, oversample, shuffle,
    undersample,
)
from mlscout.operators.split import assign_folds, class_shares, split
from mlscout.sources.sinks import sanitize

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _imputed(c):
    if c in LINE_NUMERIC:
        if c in ("l_orderkey", "l_linenumber"):
            return c
        return f"coalesce({c}, (SELECT median({c}) FROM t)) AS {c}"
    mode = f"SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1"
    return f"coalesce({c}, ({mode})) AS {c}"


IMPUTED = "SELECT " + ", ".join(_imputed(c) for c in LINE_COLUMNS) + " FROM t"


def _capped(c, source, keep=()):
    if c in LINE_TEXT or c in keep:
        return c
    q = f"(SELECT quantile_cont({c}::DOUBLE, {{p}}) FROM {source})"
    q1, q3 = q.format(p=0.25), q.format(p=0.75)
    low, high = f"({q1} - 1.5 * ({q3} - {q1}))", f"({q3} + 1.5 * ({q3} - {q1}))"
    return f"round(CASE WHEN {c} IS NOT NULL THEN greatest(least({c}::DOUBLE, {high}), {low}) END, 6) AS {c}"


@query(
    "impute",
    f"WITH {LINES_SQL}, i AS ({IMPUTED}) SELECT "
    + ", ".join(
        f"round({c}, 6) AS {c}" if c in LINE_NUMERIC[2:] else c for c in LINE_COLUMNS
    )
    + " FROM i",
)
def _(spark, folder):
    return rounded(impute(lines(spark, folder)))


@query(
    "drop_missing_rows",
    f"WITH {LINES_SQL} SELECT * FROM t WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in LINE_COLUMNS),
)
def _(spark, folder):
    return drop_missing_rows(lines(spark, folder))


@query("drop_missing_columns", f"WITH {LINES_SQL} SELECT * EXCLUDE (l_discount) FROM t")
def _(spark, folder):
    return drop_missing_columns(lines(spark, folder), "l_linestatus")


@query(
    "cap_iqr",
    "WITH t AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 8 = 0 THEN NULL ELSE "
    "value END AS value FROM events), q AS (SELECT quantile_cont(value, 0.25) AS q1, "
    "quantile_cont(value, 0.75) AS q3 FROM t) SELECT event_id, user_id, event_type, "
    "round(CASE WHEN value IS NOT NULL THEN greatest(least(value, q3 + 1.5 * (q3 - q1)), "
    "q1 - 1.5 * (q3 - q1)) END, 6) AS value FROM t, q",
)
def _(spark, folder):
    rows = table(spark, folder, "events").selectExpr(
        "event_id", "user_id", "event_type",
        "CASE WHEN event_id % 8 = 0 THEN NULL ELSE value END AS value",
    )
    capped = cap_iqr(rows, "event_id")
    return rounded(capped.withColumn("user_id", F.col("user_id").cast("bigint")))


LABELS = "(SELECT doc_id, quality, toxic FROM labels)"


def _counts_sql(target, chosen):
    return f"SELECT {target}, {chosen} AS n FROM g"


@query(
    "oversample_counts",
    "WITH g AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) "
    "SELECT toxic, (SELECT max(n) FROM g) AS n FROM g",
)
def _(spark, folder):
    rows = oversample(table(spark, folder, "labels"), "toxic", key="doc_id")
    return rows.groupBy("toxic").agg(F.count("*").alias("n"))


@query(
    "oversample_rows",
    "WITH g AS (SELECT c_mktsegment, count(*) AS n, max(count(*)) OVER () AS top FROM customer GROUP BY 1), "
    f"h AS (SELECT c_custkey, c_mktsegment, {hash_sql('c_custkey', 123)} AS h FROM customer), "
    "r AS (SELECT c_custkey, c_mktsegment, top // n + CASE WHEN row_number() OVER (PARTITION BY "
    "c_mktsegment ORDER BY h, c_custkey) <= top % n THEN 1 ELSE 0 END AS copies FROM h JOIN g "
    "USING (c_mktsegment)) SELECT c_custkey, c_mktsegment, CAST(copies AS BIGINT) AS copies FROM r",
)
def _(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return (
        oversample(rows, "c_mktsegment", key="c_custkey")
        .groupBy("c_custkey", "c_mktsegment")
        .agg(F.count("*").alias("copies"))
    )


@query(
    "undersample_rows",
    f"WITH h AS (SELECT doc_id, quality, toxic, {hash_sql('doc_id', 123)} AS h FROM labels), r AS "
    "(SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY h, doc_id) AS place FROM h) "
    "SELECT doc_id, quality, toxic FROM r WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n "
    "FROM labels GROUP BY toxic))",
)
def _(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return undersample(rows, "toxic", key="doc_id")


@query(
    "shuffle",
    "SELECT doc_id, quality, toxic FROM labels",
)
def _(spark, folder):
    return shuffle(table(spark, folder, "labels").select("doc_id", "quality", "toxic"), key="doc_id")


@query(
    "clean_pipeline",
    f"WITH {LINES_SQL}, i AS ({IMPUTED}) SELECT "
    + ", ".join(_capped(c, "i", keep=["l_orderkey", "l_linenumber"]) for c in LINE_COLUMNS)
    + " FROM i",
)
def _(spark, folder):
    found = rounded(clean(lines(spark, folder), "l_linestatus", "impute", "cap_iqr"))
    return found.withColumns(
        {
            "l_orderkey": F.col("l_orderkey").cast("bigint"),
            "l_linenumber": F.col("l_linenumber").cast("int"),
        }
    )


# -- splits -------------------------------------------------------------------


@query(
    "split_rows_plain",
    f"SELECT o_orderkey, {hash_sql('o_orderkey', 123)} < {int(0.75 * HASH_RANGE)} AS is_train FROM orders",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return split(rows, "o_totalprice", "regression", key="o_orderkey").rows.select(
        "o_orderkey", "is_train"
    )


STRATIFIED = (
    f"h AS (SELECT o_orderkey, o_orderstatus, {hash_sql('o_orderkey', 123)} AS h FROM orders), "
    "s AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY "
    "h, o_orderkey) <= floor(0.75 * count(*) OVER (PARTITION BY o_orderstatus)) AS is_train FROM h)"
)


def _stratified(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return split(rows, "o_orderstatus", "classification", key="o_orderkey").rows


@query("split_rows_stratified", f"WITH {STRATIFIED} SELECT * FROM s")
def _(spark, folder):
    return _stratified(spark, folder)


@query(
    "split_class_shares",
    f"WITH {STRATIFIED} SELECT is_train, o_orderstatus, count(*) AS n, round(count(*) / "
    "sum(count(*)) OVER (PARTITION BY is_train), 6) AS share FROM s GROUP BY 1, 2",
)
def _(spark, folder):
    return rounded(class_shares(_stratified(spark, folder), "o_orderstatus", "is_train"))


@query(
    "fold_rows_plain",
    f"SELECT o_orderkey, CAST({hash_sql('o_orderkey', 456)} % 5 AS INTEGER) AS fold FROM orders",
)
def _(spark, folder):
    return assign_folds(table(spark, folder, "orders").select("o_orderkey"), 5, "o_orderkey")


@query(
    "fold_rows_stratified",
    f"WITH h AS (SELECT doc_id, toxic, {hash_sql('doc_id', 456)} AS h FROM labels) SELECT doc_id, "
    "toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY h, doc_id) - 1) % 5 AS INTEGER) "
    "AS fold FROM h",
)
def _(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", "toxic")
    return assign_folds(rows, 5, "doc_id", stratify="toxic")


# -- sanitising and scalars ---------------------------------------------------


@query(
    "sanitize",
    "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '=' || text WHEN doc_id % 4 = 1 THEN "
    "'-' || text WHEN doc_id % 4 = 2 THEN NULL ELSE text END AS text, lang FROM documents) SELECT doc_id, "
    "CASE WHEN substr(text, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || text ELSE text END "
    "AS text, lang FROM t",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 4 = 0 THEN '=' || text WHEN doc_id % 4 = 1 THEN '-' || text "
        "WHEN doc_id % 4 = 2 THEN NULL ELSE text END AS text",
        "lang",
    )
    return sanitize(rows)


@query(
    "html_escape",
    "SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', "
    "'&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM pages",
)
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", html_escape(F.col("html")).alias("html"))


@query(
    "pseudonymise",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE substr(sha256(c_name), 1, 8) "
    "END AS token FROM customer",
)
def _(spark, folder):
    name = F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("c_name"))
    return table(spark, folder, "customer").select("c_custkey", pseudonymise(name).alias("token"))


@query(
    "number_text",
    f"SELECT p_partkey, {text_sql('p_retailprice / 8', 1)} AS one, {text_sql('p_size * 10.0e0', 4)} "
    "AS four FROM part",
)
def _(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        number_text(F.col("p_retailprice") / 8, 1).alias("one"),
        number_text(F.col("p_size") * 10.0, 4).alias("four"),
    )
