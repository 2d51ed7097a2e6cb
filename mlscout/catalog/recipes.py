"""Recipe steps as queries: fitted on the training side of a split, applied to all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlscout.catalog.fixtures import EVENTS_SQL, events, hash_sql, lines, rounded, table, LINES_SQL
from mlscout.functions.hashing import HASH_RANGE, row_hash
from mlscout.operators.issues import find_issues
from mlscout.operators.profile import profile
from mlscout.operators.gram import pair_correlations
from mlscout.operators.recipe import (
    DropColumns, DropCorrelated, DropMissingColumns, DropNearZeroVariance, DropUnusedLevels,
    DropZeroVariance, Dummy, ImputeMedian, ImputeMode, IntegerEncode, MinMax, NovelLevel,
    OmitMissing, PoolRare, Recipe, Standardize, correlation_matrix, default_recipe, prep_recipe,
    recipe_from_options,
)

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


CUT = int(0.75 * HASH_RANGE)


def _fit_apply(df, key, steps, target="_none", ids=()):
    """Fit on the 75 % of rows with the lowest key hash, apply to every row."""
    train = df.filter(row_hash([key], 123) < CUT)
    fitted = Recipe(target, steps, [key, *ids]).fit(train)
    return fitted.apply(df)


def _train_sql(key):
    return f"tr AS (SELECT * FROM t WHERE {hash_sql(key, 123)} < {CUT})"


EV = f"WITH {EVENTS_SQL}, {_train_sql('event_id')}"
PART = f"WITH t AS (SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part), {_train_sql('p_partkey')}"


def _parts(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"
    )


@query(
    "recipe_impute_median",
    f"{EV} SELECT event_id, round(coalesce(value, (SELECT median(value) FROM tr)), 6) AS value, "
    "user_id::DOUBLE AS user_id, event_type FROM t",
)
def _(spark, folder):
    return rounded(_fit_apply(events(spark, folder), "event_id", [ImputeMedian()]))


@query(
    "recipe_impute_mode",
    f"{EV} SELECT event_id, round(value, 6) AS value, user_id, coalesce(event_type, (SELECT event_type "
    "FROM tr WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM t",
)
def _(spark, folder):
    return rounded(_fit_apply(events(spark, folder), "event_id", [ImputeMode()]))


# a level that training rows never show: the rule is on the same hash as the split
UNSEEN = f"CASE WHEN {hash_sql('event_id', 123)} >= {CUT} AND event_id % 3 = 0 THEN 'fresh' ELSE event_type END"


def _with_unseen(spark, folder):
    rows = events(spark, folder)
    unseen = (row_hash(["event_id"], 123) >= CUT) & (F.col("event_id") % 3 == 0)
    return rows.withColumn("event_type", F.when(unseen, F.lit("fresh")).otherwise(F.col("event_type")))


UN = (
    f"WITH {EVENTS_SQL.replace('t AS', 't0 AS', 1)}, t AS (SELECT event_id, value, user_id, "
    f"{UNSEEN} AS event_type FROM t0), {_train_sql('event_id')}"
)


@query(
    "recipe_novel_level",
    f"{UN} SELECT event_id, CASE WHEN event_type IS NULL OR event_type IN (SELECT event_type FROM tr "
    "WHERE event_type IS NOT NULL) THEN event_type ELSE 'new' END AS event_type FROM t",
)
def _(spark, folder):
    out = _fit_apply(_with_unseen(spark, folder), "event_id", [NovelLevel(), DropUnusedLevels()])
    return out.select("event_id", "event_type")


POOLED = (
    "share AS (SELECT p_brand AS v, count(*) / sum(count(*)) OVER () AS s FROM tr GROUP BY 1)"
)
# 25 brands hold about 4 % each: some reach the threshold, the rest are pooled
THRESHOLD = 0.04


@query(
    "recipe_pool_rare",
    f"{PART}, {POOLED} SELECT p_partkey, CASE WHEN p_brand IN (SELECT v FROM share WHERE s >= "
    f"{THRESHOLD}) THEN p_brand ELSE 'OTHER' END AS p_brand FROM t",
)
def _(spark, folder):
    rows = _parts(spark, folder).select("p_partkey", "p_brand")
    return _fit_apply(rows, "p_partkey", [PoolRare(threshold=THRESHOLD)])


def _dummies(values, column, skip_first=True):
    return ", ".join(
        f"CASE WHEN {column} = '{v}' THEN 1.0e0 ELSE 0.0e0 END AS {column}_{v}"
        for v in values[1 if skip_first else 0 :]
    )


KIND_LEVELS = ["click", "error", "purchase", "signup", "view"]


@query("recipe_dummy", f"{UN} SELECT event_id, {_dummies(KIND_LEVELS, 'event_type')} FROM t")
def _(spark, folder):
    rows = _with_unseen(spark, folder).select("event_id", "event_type")
    return _fit_apply(rows, "event_id", [Dummy()])


@query(
    "recipe_one_hot",
    f"{UN} SELECT event_id, {_dummies(KIND_LEVELS, 'event_type', False)} FROM t",
)
def _(spark, folder):
    rows = _with_unseen(spark, folder).select("event_id", "event_type")
    return _fit_apply(rows, "event_id", [Dummy(one_hot=True)])


@query(
    "recipe_integer",
    f"{UN} SELECT event_id, CASE WHEN event_type IS NULL THEN NULL ELSE coalesce(list_position("
    "(SELECT list(DISTINCT event_type ORDER BY event_type) FROM tr WHERE event_type IS NOT NULL), "
    "event_type), 0) END::INTEGER AS event_type FROM t",
)
def _(spark, folder):
    rows = _with_unseen(spark, folder).select("event_id", "event_type")
    return _fit_apply(rows, "event_id", [IntegerEncode()])


@query(
    "recipe_zero_variance",
    "SELECT event_id, value, event_type FROM events",
)
def _(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id", "value", "event_type", F.lit(7).alias("seven"), F.lit("x").alias("x")
    )
    return _fit_apply(rows, "event_id", [DropZeroVariance()])


@query(
    "recipe_standardize",
    f"{EV} SELECT event_id, round((value - (SELECT avg(value) FROM tr)) / (SELECT stddev_samp(value) "
    "FROM tr), 6) AS value, round((user_id - (SELECT avg(user_id) FROM tr)) / (SELECT "
    "stddev_samp(user_id) FROM tr), 6) AS user_id FROM t",
)
def _(spark, folder):
    rows = events(spark, folder).drop("event_type")
    return rounded(_fit_apply(rows, "event_id", [Standardize()]))


@query(
    "recipe_min_max",
    f"{EV} SELECT event_id, round((value - (SELECT min(value) FROM tr)) / (SELECT max(value) - "
    "min(value) FROM tr), 6) AS value, round((user_id - (SELECT min(user_id) FROM tr)) / (SELECT "
    "max(user_id) - min(user_id) FROM tr)::DOUBLE, 6) AS user_id FROM t",
)
def _(spark, folder):
    rows = events(spark, folder).drop("event_type")
    return rounded(_fit_apply(rows, "event_id", [MinMax()]))


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "recipe_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
        for a in CORRELATED
        for b in CORRELATED
    ),
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem")
    matrix = correlation_matrix(rows, CORRELATED)
    cells = [
        (a, b, float(matrix[i][j])) for i, a in enumerate(CORRELATED) for j, b in enumerate(CORRELATED)
    ]
    return rounded(spark.createDataFrame(cells, "a string, b string, r double"))


GAPS = {
    "l_quantity": "CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity END",
    "l_extendedprice": "CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice END",
    "l_discount": "CASE WHEN l_discount > 0 THEN l_discount END",
    "l_tax": "l_tax",
    "l_partkey": "CASE WHEN l_quantity > 10 THEN CAST(l_partkey AS DOUBLE) END",
    "never": "CAST(NULL AS DOUBLE)",
    "constant": "CASE WHEN l_orderkey % 2 = 0 THEN CAST(0.1 AS DOUBLE) END",
}


@query(
    "recipe_correlation_pairwise",
    f"WITH t AS (SELECT {', '.join(f'{e} AS {c}' for c, e in GAPS.items())} FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, count({a} + {b}) AS n, "
        + ("CAST(NULL AS DOUBLE)" if {"never", "constant"} & {a, b} else f"round(corr({a}, {b}), 6)")
        + " AS r FROM t"
        for i, a in enumerate(GAPS)
        for b in list(GAPS)[i + 1 :]
    ),
)
def _(spark, folder):
    # columns with gaps of their own: each pair over the rows where both are there
    rows = table(spark, folder, "lineitem").selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in GAPS.items()])
    return rounded(pair_correlations(rows, list(GAPS)))


@query(
    "recipe_drop_correlated",
    "SELECT event_id, value, user_id FROM events",
)
def _(spark, folder):
    # twice the value is one copy too many; the later of two equal columns goes
    rows = table(spark, folder, "events").select(
        "event_id", "value", "user_id", (F.col("value") * 2 + 1).alias("doubled")
    )
    return _fit_apply(rows, "event_id", [DropCorrelated()])


@query(
    "recipe_near_zero_variance",
    f"WITH t AS (SELECT event_id, value, CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS mostly_zero, "
    "event_type FROM events) SELECT event_id, value, event_type FROM t",
)
def _(spark, folder):
    rows = table(spark, folder, "events").selectExpr(
        "event_id", "value", "CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS mostly_zero", "event_type"
    )
    return _fit_apply(rows, "event_id", [DropNearZeroVariance()])


@query("recipe_drop_columns", f"WITH {EVENTS_SQL} SELECT * EXCLUDE (value) FROM t")
def _(spark, folder):
    return _fit_apply(events(spark, folder), "event_id", [DropColumns(["value"])])


@query("recipe_drop_missing_columns", f"WITH {LINES_SQL} SELECT * EXCLUDE (l_discount) FROM t")
def _(spark, folder):
    return _fit_apply(lines(spark, folder), "l_orderkey", [DropMissingColumns()])


@query(
    "recipe_omit_missing",
    f"WITH {EVENTS_SQL} SELECT * FROM t WHERE value IS NOT NULL AND event_type IS NOT NULL",
)
def _(spark, folder):
    rows = events(spark, folder)
    return Recipe("_none", [OmitMissing()]).fit(rows).apply(rows, training=True)


@query(
    "recipe_default",
    f"WITH t AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS "
    f"p_size, p_retailprice FROM part), {_train_sql('p_partkey')}, "
    "f AS (SELECT p_partkey, p_type, coalesce(p_size, (SELECT median(p_size) FROM tr)) AS p_size, "
    "p_retailprice, p_partkey IN (SELECT p_partkey FROM tr) AS train FROM t), "
    "lv AS (SELECT DISTINCT p_type AS v FROM tr), "
    "s AS (SELECT avg(p_size) FILTER (WHERE train) AS m, stddev_samp(p_size) FILTER (WHERE train) AS d FROM f) "
    "SELECT p_partkey, p_retailprice, round((p_size - m) / d, 5) AS p_size FROM f, s",
)
def _(spark, folder):
    rows = table(spark, folder, "part").selectExpr(
        "p_partkey", "p_type",
        "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS p_size", "p_retailprice",
    )
    train = rows.filter(row_hash(["p_partkey"], 123) < CUT)
    out = default_recipe("p_retailprice", ["p_partkey"]).fit(train).apply(rows)
    return rounded(out.select("p_partkey", "p_retailprice", "p_size"), 5)


@query(
    "recipe_default_dummies",
    "WITH t AS (SELECT p_partkey, p_type, p_retailprice FROM part), "
    f"{_train_sql('p_partkey')}, lv AS (SELECT p_type AS v, row_number() OVER (ORDER BY p_type) AS place "
    "FROM (SELECT DISTINCT p_type FROM tr)), d AS (SELECT v, p_partkey, "
    "CASE WHEN p_type = v THEN 1.0e0 ELSE 0.0e0 END AS x FROM t CROSS JOIN lv WHERE place > 1), "
    f"m AS (SELECT v, avg(x) AS m, stddev_samp(x) AS s FROM d WHERE {hash_sql('p_partkey', 123)} < {CUT} "
    "GROUP BY v) SELECT p_partkey, 'p_type_' || v AS feature, round((x - m) / s, 5) AS value FROM d JOIN m "
    "USING (v)",
)
def _(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_type", "p_retailprice")
    train = rows.filter(row_hash(["p_partkey"], 123) < CUT)
    fitted = default_recipe("p_retailprice", ["p_partkey"]).fit(train)
    out = fitted.apply(rows).unpivot(["p_partkey"], fitted.features, "feature", "value")
    return rounded(out, 5)


@query(
    "recipe_prep",
    f"WITH {LINES_SQL}, {_train_sql('l_orderkey')}, f AS (SELECT l_orderkey, l_linestatus, "
    "coalesce(l_tax, (SELECT median(l_tax) FROM tr)) AS l_tax, "
    f"{hash_sql('l_orderkey', 123)} < {CUT} AS train FROM t), s AS (SELECT avg(l_tax) FILTER (WHERE train) "
    "AS m, stddev_samp(l_tax) FILTER (WHERE train) AS d FROM f) SELECT l_orderkey, l_linestatus, "
    "round((l_tax - m) / d, 5) AS l_tax FROM f, s",
)
def _(spark, folder):
    rows = lines(spark, folder).select("l_orderkey", "l_linestatus", "l_discount", "l_tax")
    issues = find_issues(profile(rows))
    train = rows.filter(row_hash(["l_orderkey"], 123) < CUT)
    out = prep_recipe("l_linestatus", issues, ["l_orderkey"]).fit(train).apply(rows)
    return rounded(out, 5)


@query(
    "recipe_from_options",
    f"{EV} SELECT event_id, event_type, round((coalesce(value, (SELECT median(value) FROM tr)) - "
    "(SELECT min(value) FROM tr)) / (SELECT max(value) - min(value) FROM tr), 6) AS value, "
    "round((user_id - (SELECT min(user_id) FROM tr)) / (SELECT max(user_id) - min(user_id) FROM tr)::DOUBLE, 6) "
    "AS user_id FROM t",
)
def _(spark, folder):
    rows = events(spark, folder)
    train = rows.filter(row_hash(["event_id"], 123) < CUT)
    recipe = recipe_from_options("event_type", "impute", "label", "minmax", ["event_id"])
    return rounded(recipe.fit(train).apply(rows))
