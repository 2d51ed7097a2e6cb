"""Learners, tuning, comparison and validation as queries.

Closed-form learners are checked by SQL. The others are checked by their row shape here
and by invariants in the tests; they use small settings to keep the check quick, and
always the whole table.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mlscout.catalog.fixtures import hash_sql, rounded, table
from mlscout.functions.hashing import HASH_RANGE, row_hash
from mlscout.operators.bayes import gaussian_nb, gaussian_nb_predict
from mlscout.operators.neighbours import kernel_weight, nearest_neighbours
from mlscout.plans.estimators import plain_linear
from mlscout.plans.findings import explain, report_lines
from mlscout.plans.knn import NeighbourVote
from mlscout.plans.pruning import pruning_table
from mlscout.plans.train import compare, permutation_importance, train
from mlscout.plans.validate import validate

QUERIES = {}
ORACLES = {}
CUT = int(0.75 * HASH_RANGE)


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# -- closed forms -------------------------------------------------------------


@query(
    "ols_univariate",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, "
    "l_quantity), 2) AS intercept FROM lineitem",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("label"), F.col("l_quantity").cast("double").alias("q")
    )
    vectors = VectorAssembler(inputCols=["q"], outputCol="features").transform(rows)
    model = plain_linear("regression").fit(vectors)
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), 3), round(float(model.intercept), 2))],
        "slope double, intercept double",
    )


NB = (
    "g AS (SELECT event_type AS c, count(*) / (SELECT count(*) FROM events) AS p, avg(value) AS m1, "
    "greatest(var_pop(value), 1e-9) AS v1, avg(user_id) AS m2, greatest(var_pop(user_id), 1e-9) AS v2 FROM events "
    "GROUP BY 1)"
)


STEPS = "100.0 * (g >= 2)::INT + 10.0 * (g = 1)::INT + 3.0 * (g = 3)::INT + l_discount"


@query(
    "tree_pruning_sequence",
    # four groups in a tree of two levels: the pair 2 | 3 goes first, then 0 | 1, then the root
    f"WITH t AS (SELECT g, g >= 2 AS high, {STEPS} AS y FROM (SELECT l_linenumber % 4 AS g, l_discount FROM lineitem)), "
    "l AS (SELECT high, sum(sse) AS sse FROM (SELECT high, g, var_pop(y) * count(*) AS sse FROM t GROUP BY ALL) GROUP BY 1), "
    "p AS (SELECT high, var_pop(y) * count(*) AS sse FROM t GROUP BY 1), "
    "r AS (SELECT var_pop(y) * count(*) AS sse FROM t), "
    "c AS (SELECT 0 AS step, 0.0 AS saved, 4 AS leaves UNION ALL "
    "SELECT 1, (SELECT p.sse - l.sse FROM p JOIN l USING (high) WHERE high), 3 UNION ALL "
    "SELECT 2, (SELECT p.sse - l.sse FROM p JOIN l USING (high) WHERE NOT high), 2 UNION ALL "
    "SELECT 3, (SELECT sse FROM r) - (SELECT sum(sse) FROM p), 1) "
    "SELECT step, round(saved / (SELECT sse FROM r), 6) AS complexity, leaves FROM c",
)
def _(spark, folder):
    group = F.col("l_linenumber") % 4
    rows = table(spark, folder, "lineitem").select(
        array_to_vector(F.array(group.cast("double"))).alias("features"),
        (
            F.when(group >= 2, 100.0).otherwise(0.0) + F.when(group == 1, 10.0).otherwise(0.0)
            + F.when(group == 3, 3.0).otherwise(0.0) + F.col("l_discount").cast("double")
        ).alias("label"),
    )
    steps = pruning_table(rows, "regression", depth=2)
    return rounded(spark.createDataFrame(steps, "step int, complexity double, leaves int"))


@query(
    "nb_gaussian_model",
    "SELECT event_type AS class, count(*) AS n, round(avg(value), 6) AS mean_0, round(var_pop(value), 4) AS var_0, "
    "round(avg(user_id), 6) AS mean_1, round(var_pop(user_id), 4) AS var_1 FROM events GROUP BY 1",
)
def _(spark, folder):
    model = gaussian_nb(table(spark, folder, "events"), ["value", "user_id"], "event_type")
    digits = {"mean_0": 6, "var_0": 4, "mean_1": 6, "var_1": 4}
    return model.select(
        "class", "n", *[F.round(c, d).alias(c) for c, d in digits.items()]
    )


@query(
    "nb_gaussian_predict",
    f"WITH {NB}, s AS (SELECT event_id, c, ln(p) - 0.5 * ln(2 * pi() * v1) - (value - m1) * (value - m1) / (2 * v1) - "
    "0.5 * ln(2 * pi() * v2) - (user_id - m2) * (user_id - m2) / (2 * v2) AS score FROM events CROSS JOIN g) SELECT "
    "event_id, arg_max(c, score) AS prediction FROM s GROUP BY 1",
)
def _(spark, folder):
    rows = table(spark, folder, "events")
    features = ["value", "user_id"]
    model = gaussian_nb(rows, features, "event_type")
    return gaussian_nb_predict(rows, model, features).select("event_id", "prediction")


def _points(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("point")
    )


@query(
    "knn_exact",
    "WITH d AS (SELECT a.vec_id, b.vec_id AS key, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist "
    "FROM embeddings a CROSS JOIN embeddings b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, "
    "key) AS rank FROM d) SELECT vec_id, CAST(rank AS INTEGER) AS rank, key, round(dist, 6) AS distance FROM r WHERE "
    "rank <= 5",
)
def _(spark, folder):
    points = _points(spark, folder)
    found = nearest_neighbours(
        points.select(F.col("vec_id").alias("key"), "point"), points.select("point"), 5
    )
    out = points.select("vec_id", "point").join(found, "point").drop("point")
    return rounded(out.select("vec_id", "rank", "key", "distance"))


@query(
    "knn_vote",
    f"WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, {hash_sql('vec_id', 123)} < {CUT} AS train FROM "
    "embeddings), d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY "
    "list_distance(a.x, b.x)) AS rank FROM e a JOIN e b ON NOT a.train AND b.train), v AS (SELECT vec_id, label, "
    "count(*) AS n FROM d WHERE rank <= 5 GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER "
    "BY n DESC, label) AS place FROM v) SELECT vec_id, CAST(label AS INTEGER) AS prediction FROM p WHERE place = 1",
)
def _(spark, folder):
    rows = _points(spark, folder).select(
        "vec_id", F.col("label").cast("double").alias("label"),
        array_to_vector("point").alias("features"),
        (row_hash(["vec_id"], 123) < CUT).alias("train"),
    )
    classes = rows.agg(F.max("label")).first()[0]
    model = NeighbourVote("classification", 5, int(classes) + 1).fit(rows.filter("train"))
    scored = model.transform(rows.filter("NOT train").select("vec_id", "features"))
    return scored.select("vec_id", F.col("prediction").cast("int").alias("prediction"))


# neighbour k + 1 = 8 scales the distances of the seven that count
SCALED = (
    f"e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, {hash_sql('vec_id', 123)} < {CUT} AS train FROM embeddings), "
    "d AS (SELECT a.vec_id, b.vec_id AS key, b.label, len(b.x)::DOUBLE AS p, list_distance(a.x, b.x) AS dist FROM e a "
    "JOIN e b ON NOT a.train AND b.train), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, key) "
    "AS rank FROM d), u AS (SELECT *, least(greatest(dist / greatest(max(dist) OVER (PARTITION BY vec_id), 1e-6), 1e-6), "
    "1 - 1e-6) AS u FROM r WHERE rank <= 8), n AS (SELECT * FROM u WHERE rank <= 7)"
)
WEIGHTS = {
    "optimal": "(1 + p / 2 - p / (2 * 7 ** (2 / p)) * (rank ** (1 + 2 / p) - (rank - 1) ** (1 + 2 / p))) / 7",
    "triangular": "1 - u",
    "triweight": "35 / 32 * (1 - u * u) ** 3",
    "inv": "1 / u",
}


def _parted(spark, folder):
    rows = _points(spark, folder).withColumn("train", row_hash(["vec_id"], 123) < CUT)
    return rows.filter("train"), rows.filter("NOT train")


@query(
    "knn_kernel_weights",
    f"WITH {SCALED} SELECT vec_id, CAST(rank AS INTEGER) AS rank, key, "
    + ", ".join(f"round({weight}, 6) AS {name}" for name, weight in WEIGHTS.items())
    + " FROM n",
)
def _(spark, folder):
    near, asked = _parted(spark, folder)
    found = nearest_neighbours(near.select(F.col("vec_id").alias("key"), "point"), asked, 8)
    weights = [kernel_weight(7, kernel).alias(kernel) for kernel in WEIGHTS]
    weighted = found.select("point", "rank", "key", *weights).filter("rank <= 7")
    return rounded(asked.select("vec_id", "point").join(weighted, "point").drop("point"))


@query(
    "knn_weighted_mean",
    f"WITH {SCALED} SELECT vec_id, round(sum((1 - u) * label) / sum(1 - u), 6) AS prediction FROM n GROUP BY 1",
)
def _(spark, folder):
    near, asked = (
        x.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("point").alias("features"))
        for x in _parted(spark, folder)
    )
    scored = NeighbourVote("regression", 7, 0, "triangular").fit(near).transform(asked.drop("label"))
    return rounded(scored.select("vec_id", "prediction"))


# -- trained models -----------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber"]


def _line_prices(spark, folder):
    return table(spark, folder, "lineitem").select(
        *LINE_KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice"
    )


def _line_size(spark, folder):
    """A class that the price gives away almost fully."""
    size = F.when(F.col("l_quantity") > 35, "large").when(F.col("l_quantity") > 15, "medium").otherwise("small")
    return table(spark, folder, "lineitem").select(
        *LINE_KEY, "l_extendedprice", "l_discount", "l_returnflag", size.alias("size")
    )


def _line_bulk(spark, folder):
    rows = _line_size(spark, folder)
    return rows.withColumn("size", F.when(F.col("size") == "large", "large").otherwise("other"))


def _metrics(result):
    out = rounded(result.test_metrics, 6)
    result.release()
    return out


def _register_regression(name, engine, grid=2, **params):
    @query(f"train_{name}")
    def _(spark, folder):
        return _metrics(
            train(
                _line_prices(spark, folder), "l_extendedprice", engine, "regression",
                cv_folds=2, tune_grid=grid, key=LINE_KEY, params=params or None,
            )
        )


def _register_classes(name, engine, rows, grid=2, **params):
    @query(f"train_{name}")
    def _(spark, folder):
        return _metrics(
            train(
                rows(spark, folder), "size", engine, "classification",
                cv_folds=2, tune_grid=grid, key=LINE_KEY, params=params or None,
            )
        )


_register_regression("lasso_regression", "glmnet")
_register_regression("forest_regression", "ranger", trees=20, depth=6)
_register_regression("boosting_regression", "xgboost", grid=1, trees=10)
_register_regression("svm_regression", "kernlab", grid=1, n_features=64)
_register_regression("tree_regression", "rpart")
_register_regression("plain_regression", "lm")
_register_classes("lasso_binary", "glmnet", _line_bulk)
_register_classes("lasso_multiclass", "glmnet", _line_size)
_register_classes("forest_multiclass", "ranger", _line_size, trees=20, depth=6)
_register_classes("boosting_binary", "xgboost", _line_bulk, grid=1, trees=10)
_register_classes("boosting_multiclass", "xgboost", _line_size, grid=1, trees=5, depth=3)
_register_classes("svm_binary", "kernlab", _line_bulk, grid=1, n_features=64)
_register_classes("svm_multiclass", "kernlab", _line_size, grid=1, n_features=64)
_register_classes("tree_multiclass", "rpart", _line_size)
_register_classes("naive_bayes", "naivebayes", _line_size)
_register_classes("plain_logistic", "glm", _line_bulk)


@query("train_knn_regression")
def _(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_size", "p_type", "p_retailprice")
    return _metrics(
        train(rows, "p_retailprice", "kknn", "regression", cv_folds=2, tune_grid=2, key="p_partkey")
    )


@query("train_knn_multiclass")
def _(spark, folder):
    rows = _points(spark, folder).select(
        "vec_id", F.col("label").cast("string").alias("label_name"),
        *[F.col("point")[i].alias(f"x{i}") for i in range(64)],
    )
    return _metrics(
        train(rows, "label_name", "kknn", "classification", cv_folds=2, tune_grid=2, key="vec_id")
    )


@query("tune_cv_metrics")
def _(spark, folder):
    result = train(
        _line_prices(spark, folder), "l_extendedprice", "rpart", "regression",
        cv_folds=3, tune_grid=2, key=LINE_KEY,
    )
    result.release()
    return rounded(result.cv_metrics, 6)


@query("train_balanced")
def _(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = rows.join(table(spark, folder, "labels"), "doc_id").withColumn(
        "toxic", F.col("toxic").cast("string")
    )
    return _metrics(
        train(
            joined, "toxic", "naivebayes", "classification", cv_folds=2, key="doc_id",
            balance="oversample",
        )
    )


@query("predict_test_rows")
def _(spark, folder):
    result = train(
        _line_bulk(spark, folder), "size", "rpart", "classification", cv_folds=2, tune_grid=1, key=LINE_KEY
    )
    return result.predictions.select(
        *LINE_KEY, "size", "prediction", F.round(F.get("probability", F.lit(0)), 6).alias("p_large")
    )


@query("importance_native")
def _(spark, folder):
    result = train(
        _line_prices(spark, folder), "l_extendedprice", "glmnet", "regression",
        cv_folds=2, tune_grid=1, key=LINE_KEY,
    )
    result.release()
    return rounded(result.importance, 4)


@query("importance_permutation")
def _(spark, folder):
    result = train(
        _line_size(spark, folder), "size", "naivebayes", "classification", cv_folds=2, key=LINE_KEY
    )
    out = permutation_importance(result.model, result.test_data, LINE_KEY)
    result.release()
    return rounded(out, 6)


@query("compare_models")
def _(spark, folder):
    found = compare(
        _line_prices(spark, folder), "l_extendedprice", "regression", ["glmnet", "rpart", "lm"],
        cv_folds=2, tune_grid=1, key=LINE_KEY,
    )
    found.release()
    return rounded(found.table, 4)


def _by_status(spark, folder, status):
    return _line_prices(spark, folder).filter(F.col("l_linestatus") == status)


@query("validate_regression")
def _(spark, folder):
    """Trained on closed lines, validated on open ones."""
    result = train(
        _by_status(spark, folder, "F"), "l_extendedprice", "lm", "regression", cv_folds=2, key=LINE_KEY
    )
    result.release()
    return rounded(validate(result, _by_status(spark, folder, "O")).drift, 4)


@query("validate_classification")
def _(spark, folder):
    rows = _line_size(spark, folder)
    result = train(
        rows.filter("l_returnflag <> 'R'"), "size", "rpart", "classification",
        cv_folds=2, tune_grid=1, key=LINE_KEY,
    )
    result.release()
    return rounded(validate(result, rows.filter("l_returnflag = 'R'")).metrics, 6)


@query("explain_model")
def _(spark, folder):
    result = train(
        _line_prices(spark, folder), "l_extendedprice", "glmnet", "regression",
        cv_folds=2, tune_grid=1, key=LINE_KEY,
    )
    out = explain(result)
    return rounded(out, 4)


@query("report_lines")
def _(spark, folder):
    result = train(
        _line_size(spark, folder), "size", "naivebayes", "classification", cv_folds=2, key=LINE_KEY
    )
    return report_lines(result)
