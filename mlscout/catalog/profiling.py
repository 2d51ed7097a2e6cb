"""Profile, issues, audits, task detection and recommendations as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlscout.catalog.fixtures import (
    LINE_COLUMNS, LINE_NUMERIC, LINE_TEXT, LINES_SQL, lines, rounded, table, text_sql,
)
from mlscout.operators.issues import NO_STEPS, PREP_ACTIONS, find_issues, prep_steps
from mlscout.operators.profile import (
    avg_missing, cleaning_summary, profile, profile_categorical, profile_correlations,
    profile_histogram, profile_missing, profile_numeric, profile_outliers, profile_structure,
    profile_top_values, profile_types, round_numeric,
)
from mlscout.operators.recommend import (
    COMPATIBILITY, LASSO_NAMES, METHOD_NAMES, NOTES, default_selection, filter_compatible,
    recommend,
)
from mlscout.operators.task import detect_task, needs_regularization
from mlscout.sources.audits import audit_columns, audit_dimensions, check_schema
from mlscout.sources.readers import preview

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def per_column(columns, select, source="t"):
    return " UNION ALL ".join(
        f"SELECT {select.format(c=c, i=i)} FROM {source}" for i, c in enumerate(columns)
    )


def types_of(c):
    kinds = {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double"}
    return kinds.get(c, "string" if c in LINE_TEXT else "double")


MISSING = per_column(
    LINE_COLUMNS,
    "{i} AS position, '{c}' AS \"column\", count(*) - count({c}) AS n_missing, "
    "round((count(*) - count({c})) * 100.0e0 / count(*), 6) AS pct_missing",
)
NUMERIC = per_column(
    LINE_NUMERIC,
    "{i} AS position, '{c}' AS \"column\", round(avg({c}), 4) AS mean, "
    "round(median({c}::DOUBLE), 4) AS median, round(stddev_samp({c}), 4) AS sd, "
    "round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, "
    "count(DISTINCT {c}) AS n_unique, 0::BIGINT AS n_infinite",
)
CATEGORICAL = per_column(
    LINE_TEXT,
    "{i} AS position, '{c}' AS \"column\", count(DISTINCT {c}) + "
    "max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique",
)


@query(
    "profile_structure",
    f"WITH {LINES_SQL} SELECT count(*) AS n_rows, {len(LINE_COLUMNS)} AS n_cols, "
    f"'{','.join(LINE_COLUMNS)}' AS col_names FROM t",
)
def _(spark, folder):
    found = profile_structure(lines(spark, folder))
    return found.withColumn("col_names", F.array_join("col_names", ","))


@query(
    "profile_types",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{c}', '{types_of(c)}')" for i, c in enumerate(LINE_COLUMNS))
    + ') v(position, "column", type)',
)
def _(spark, folder):
    return profile_types(lines(spark, folder))


@query("profile_missing", f"WITH {LINES_SQL} {MISSING}")
def _(spark, folder):
    return rounded(profile_missing(lines(spark, folder)))


@query("profile_numeric", f"WITH {LINES_SQL} {NUMERIC}")
def _(spark, folder):
    return rounded(profile_numeric(lines(spark, folder)), 4)


@query("profile_categorical", f"WITH {LINES_SQL} {CATEGORICAL}")
def _(spark, folder):
    return profile_categorical(lines(spark, folder))


@query(
    "profile_top_values",
    f"WITH {LINES_SQL}, c AS (SELECT position, \"column\", value, count(*) AS n FROM ("
    + per_column(LINE_TEXT, "{i} AS position, '{c}' AS \"column\", {c} AS value")
    + ") GROUP BY ALL), r AS (SELECT position, \"column\", CAST(row_number() OVER (PARTITION BY "
    "\"column\" ORDER BY n DESC, value) AS INTEGER) AS rank, value, n FROM c WHERE value IS NOT NULL) "
    "SELECT * FROM r WHERE rank <= 5",
)
def _(spark, folder):
    return profile_top_values(lines(spark, folder))


@query(
    "profile_top_values_told",
    # order keys have more values than are listed, and one column has none at all
    "WITH v AS (SELECT 0 AS position, 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) AS n FROM orders "
    "GROUP BY ALL), k AS (SELECT count(DISTINCT o_orderkey) AS n FROM orders) "
    "SELECT position, \"column\", CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank, value, n FROM v "
    "UNION ALL SELECT 1, 'order', NULL, 'too many values to show: ' || n, NULL FROM k "
    "UNION ALL SELECT 2, 'nothing', NULL, 'no values', NULL",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").selectExpr(
        "o_orderpriority", "CAST(o_orderkey AS STRING) AS `order`", "CAST(NULL AS STRING) AS nothing"
    )
    return profile_top_values(rows, max_unique=1000)


@query(
    "profile_avg_missing",
    f"WITH {LINES_SQL}, m AS ({MISSING}) SELECT round(avg(pct_missing), 4) AS avg_pct_missing, "
    "avg(pct_missing) > 20 AS flagged FROM m",
)
def _(spark, folder):
    return rounded(avg_missing(profile_missing(lines(spark, folder))), 4)


@query(
    "cleaning_summary",
    f"WITH {LINES_SQL}, m AS ({MISSING}) SELECT CAST(sum(n_missing) AS BIGINT) AS missing_cells, "
    f"{len(LINE_NUMERIC)} AS n_numeric, {len(LINE_TEXT)} AS n_categorical FROM m",
)
def _(spark, folder):
    return cleaning_summary(lines(spark, folder))


@query(
    "round_numeric",
    "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice / 7, 3) AS o_totalprice "
    "FROM orders",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") / 7).alias("o_totalprice")
    )
    return round_numeric(rows, 3)


FENCES = per_column(
    LINE_NUMERIC,
    "{i} AS position, '{c}' AS \"column\", quantile_cont({c}::DOUBLE, 0.25) AS q1, "
    "quantile_cont({c}::DOUBLE, 0.75) AS q3",
)


@query(
    "profile_outliers",
    f"WITH {LINES_SQL}, q AS ({FENCES}), f AS (SELECT position, \"column\", "
    "q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q), v AS ("
    + per_column(LINE_NUMERIC, "'{c}' AS \"column\", {c}::DOUBLE AS value")
    + ") SELECT position, f.\"column\", round(lower, 4) AS lower, round(upper, 4) AS upper, "
    "count(*) FILTER (WHERE value < lower OR value > upper) AS n_outliers FROM f JOIN v USING "
    '("column") GROUP BY ALL',
)
def _(spark, folder):
    return rounded(profile_outliers(lines(spark, folder)), 4)


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "profile_correlations",
    f"WITH {LINES_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM t"
        for i, a in enumerate(CORRELATED)
        for b in CORRELATED[i + 1 :]
    ),
)
def _(spark, folder):
    return rounded(profile_correlations(lines(spark, folder).select(*CORRELATED)))


@query(
    "profile_histogram",
    "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT "
    "CAST(least(floor((value - lo) / ((hi - lo) / 10)) + 1, 10) AS INTEGER) AS bin, lo, hi "
    "FROM events CROSS JOIN e) SELECT 0 AS position, 'value' AS \"column\", bin, "
    "round(lo + (bin - 1) * (hi - lo) / 10, 4) AS bin_start, round(lo + bin * (hi - lo) / 10, 4) "
    "AS bin_end, count(*) AS n FROM b GROUP BY ALL",
)
def _(spark, folder):
    return rounded(profile_histogram(table(spark, folder, "events").select("value"), 10), 4)


ISSUES = (
    f"{LINES_SQL}, m AS ({MISSING}), k AS ({CATEGORICAL}), s AS ("
    + per_column(
        LINE_NUMERIC,
        "{i} AS position, '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS sd",
    )
    + "), issues AS (SELECT \"column\", 'high_missing' AS issue_type, "
    + text_sql("pct_missing", 1)
    + " || '% missing values' AS description, 'high' AS severity, position FROM m "
    "WHERE pct_missing > 50 UNION ALL SELECT \"column\", 'high_cardinality', n_unique || "
    "' unique values', 'medium', position FROM k WHERE n_unique > 10 UNION ALL SELECT \"column\", "
    "'near_zero_variance', 'Coefficient of variation = ' || "
    + text_sql("abs(sd / mean)", 4)
    + ", 'low', position FROM s WHERE abs(mean) > 1e-10 AND abs(sd / mean) < 0.01)"
)


@query("find_issues", f"WITH {ISSUES} SELECT * FROM issues")
def _(spark, folder):
    return find_issues(profile(lines(spark, folder)))


@query(
    "prep_steps",
    f"WITH {ISSUES}, g AS (SELECT issue_type, count(*) AS n, string_agg(\"column\", ', ' ORDER BY "
    "position) AS names FROM issues GROUP BY issue_type) SELECT issue_type, n, CASE issue_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PREP_ACTIONS)
    + " ELSE 'Review: ' END || names AS step FROM g",
)
def _(spark, folder):
    return prep_steps(find_issues(profile(lines(spark, folder))))


@query(
    "prep_steps_none",
    f"SELECT 'none' AS issue_type, CAST(0 AS BIGINT) AS n, '{NO_STEPS}' AS step",
)
def _(spark, folder):
    clean = table(spark, folder, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus")
    return prep_steps(find_issues(profile(clean)))


# -- task and recommendations -------------------------------------------------

_TASKS = {
    "binary": ("labels", ["quality", "toxic"], "toxic", "int"),
    "multiclass": ("customer", ["c_nationkey", "c_acctbal", "c_mktsegment"], "c_mktsegment", "string"),
    "numeric_discrete": ("embeddings", ["vec_id", "label"], "label", "int"),
    "many_levels": ("part", ["p_size", "p_retailprice", "p_type"], "p_size", "int"),
    "regression": ("orders", ["o_custkey", "o_orderstatus", "o_totalprice"], "o_totalprice", "double"),
}


def _task(spark, folder, name):
    source, columns, target, _ = _TASKS[name]
    return detect_task(table(spark, folder, source).select(*columns), target)


def _task_sql(name):
    source, columns, target, kind = _TASKS[name]
    number = kind != "string"
    p = len(columns) - 1
    whole = f"bool_and({target} = floor({target}))" if number else "true"
    text = "NOT " if number else ""
    return (
        f"g AS (SELECT {target} AS v, count(*) AS n FROM {source} WHERE {target} IS NOT NULL GROUP BY 1), "
        f"s AS (SELECT count(*) AS u, sum(n) AS obs, min(n) AS rare, "
        f"{'bool_and(v = floor(v))' if number else 'true'} AS whole FROM g), "
        f"r AS (SELECT *, CASE WHEN {text}true OR u <= 2 THEN 'classification' "
        "WHEN whole AND u <= 20 AND u / obs < 0.10 THEN 'classification' ELSE 'regression' END AS tt, "
        f"(SELECT count(*) FROM {source}) AS rows FROM s), "
        "task AS (SELECT "
        f"'{target}' AS target, '{kind}' AS target_type, u AS n_unique, tt AS task_type, "
        "CASE WHEN tt = 'regression' THEN 'continuous' WHEN u = 2 THEN 'binary' ELSE 'multiclass' END "
        "AS task_subtype, "
        f"CASE WHEN {number} AND tt = 'classification' AND u > 2 AND u / obs >= 0.05 THEN 'medium' "
        "ELSE 'high' END AS confidence, "
        "CASE WHEN tt = 'regression' THEN NULL WHEN rare / obs < 0.05 THEN 'severe' "
        "WHEN rare / obs < 0.20 THEN 'moderate' END AS imbalance, "
        "CASE WHEN tt = 'classification' THEN round(rare / obs, 6) END AS min_class_share, "
        f"rows AS n_samples, {p} AS n_predictors, round(rows / {p}, 6) AS sample_to_feature_ratio, "
        f"CAST(greatest(CASE WHEN tt = 'regression' THEN 20 ELSE 10 END * {p}, 100) AS BIGINT) "
        "AS min_recommended, "
        f"rows < greatest(CASE WHEN tt = 'regression' THEN 20 ELSE 10 END * {p}, 100) AS small_sample "
        "FROM r)"
    )


def _register_task(name):
    sql = f"WITH {_task_sql(name)} SELECT * FROM task"

    @query(f"detect_task_{name}", sql)
    def _(spark, folder):
        return rounded(_task(spark, folder, name).frame(spark).drop("note"))


for _name in _TASKS:
    _register_task(_name)


@query(
    "needs_regularization",
    " UNION ALL ".join(
        f"SELECT '{n}' AS task, ratio < 20 OR {len(t[1]) - 1} > 50 AS needed FROM "
        f"(SELECT count(*) / {len(t[1]) - 1} AS ratio FROM {t[0]})"
        for n, t in _TASKS.items()
    ),
)
def _(spark, folder):
    rows = [(n, needs_regularization(_task(spark, folder, n))) for n in _TASKS]
    return spark.createDataFrame(rows, "task string, needed boolean")


def _recommend_sql(name, order):
    source, columns, *_ = _TASKS[name]
    p = len(columns) - 1
    rules = {
        "reg_lasso": f"CASE WHEN n / {p} < 20 OR {p} > 50 THEN 1 ELSE 2 END",
        "boost": "CASE WHEN n > 1000 THEN 1 ELSE 2 END",
        "reg_svm": f"CASE WHEN n < 5000 AND {p} < 50 THEN 1 ELSE 3 END",
        "bin_svm": "CASE WHEN n < 5000 THEN 1 ELSE 3 END",
        "knn": "CASE WHEN n < 1000 THEN 2 ELSE 3 END",
    }
    subtype = {"regression": "continuous"}.get(name, name)
    names = METHOD_NAMES | {"glmnet": LASSO_NAMES[subtype]}
    return " UNION ALL ".join(
        f"SELECT '{names[e]}' AS method, {rules.get(r, r)} AS priority, '{NOTES[e][0]}' AS rationale, "
        f"'{e}' AS engine, '{NOTES[e][1]}' AS considerations FROM (SELECT count(*) AS n FROM {source})"
        for e, r in order
    )


_ORDERS = {
    "regression": [
        ("glmnet", "reg_lasso"), ("ranger", "1"), ("xgboost", "boost"), ("kernlab", "reg_svm"),
        ("kknn", "knn"), ("rpart", "3"),
    ],
    "binary": [
        ("glmnet", "1"), ("ranger", "1"), ("xgboost", "boost"), ("kernlab", "bin_svm"),
        ("naivebayes", "2"), ("kknn", "knn"), ("rpart", "3"),
    ],
    "multiclass": [
        ("glmnet", "2"), ("ranger", "1"), ("xgboost", "1"), ("naivebayes", "2"), ("kknn", "knn"),
        ("rpart", "3"),
    ],
}


def _register_recommend(name, order):
    @query(f"recommend_{name}", _recommend_sql(name, order))
    def _(spark, folder):
        return recommend(spark, _task(spark, folder, name))


for _name, _order in _ORDERS.items():
    _register_recommend(_name, _order)


@query(
    "recommend_default_selection",
    f"WITH r AS ({_recommend_sql('multiclass', _ORDERS['multiclass'])}), o AS (SELECT *, "
    "row_number() OVER (ORDER BY priority, list_position(['glmnet', 'ranger', 'xgboost', "
    "'naivebayes', 'kknn', 'rpart'], engine)) AS place FROM r) SELECT engine, priority, "
    "30 AS estimated_seconds FROM o WHERE place <= 3",
)
def _(spark, folder):
    chosen = default_selection(recommend(spark, _task(spark, folder, "multiclass")))
    return chosen.select("engine", "priority", "estimated_seconds")


def _engines(spark, folder):
    """Every known engine once per task the tables pose, and one unknown engine."""
    rows = [(e, _task(spark, folder, "binary").task_type) for e in [*COMPATIBILITY, "other"]]
    return spark.createDataFrame(rows, "engine string, task_type string")


@query(
    "filter_compatible",
    "SELECT engine, 'classification' AS task_type FROM (VALUES "
    + ", ".join(f"('{e}')" for e in [*COMPATIBILITY, "other"])
    + ") v(engine) WHERE engine <> 'lm' AND (SELECT count(DISTINCT toxic) FROM labels) = 2",
)
def _(spark, folder):
    task_type = _task(spark, folder, "binary").task_type
    return filter_compatible(_engines(spark, folder), task_type)


# -- audits and readers -------------------------------------------------------


@query(
    "audit_columns",
    "SELECT 3 AS position, 'source' AS \"column\", 'suspicious' AS rule, 'source' AS detail",
)
def _(spark, folder):
    return audit_columns(table(spark, folder, "documents"))


@query(
    "audit_dimensions",
    "SELECT 'rows' AS \"limit\", CAST(50000 AS BIGINT) AS allowed, count(*) > 50000 AS exceeded "
    "FROM lineitem UNION ALL SELECT 'cols', 1000, false UNION ALL SELECT 'cells', 10000000, "
    "count(*) * 10 > 10000000 FROM lineitem",
)
def _(spark, folder):
    return audit_dimensions(lines(spark, folder), 50_000, 1_000, 10_000_000)


@query(
    "check_schema",
    "SELECT * FROM (VALUES ('c_custkey', 'ok'), ('c_name', 'missing'), ('c_nationkey', 'ok'), "
    "('c_acctbal', 'ok'), ('c_mktsegment', 'ok'), ('extra', 'extra')) v(\"column\", status)",
)
def _(spark, folder):
    customers = table(spark, folder, "customer")
    return check_schema(customers.schema, customers.drop("c_name").withColumn("extra", F.lit(1)))


@query(
    "preview_first_rows",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return preview(rows, 100, "o_orderkey")


@query("read_parquet", "SELECT * FROM nation")
def _(spark, folder):
    from mlscout.sources.readers import read_table

    return read_table(spark, f"{folder}/nation.parquet")


