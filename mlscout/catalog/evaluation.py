"""Metrics, baselines, residual diagnostics, overfitting and drift as queries.

Predictions come from fixed rules, so that SQL can make the same ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mlscout.catalog.fixtures import (
    FLAGS_SQL, KIND_LEVELS, KINDS_SQL, PRICES_SQL, flags, kinds, prices, rounded, text_sql,
)
from mlscout.operators import diagnostics as D
from mlscout.operators import metrics as M

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _metric_sql(name, value, cte, estimator="standard", digits=6):
    return (
        f"WITH {cte} SELECT '{name}' AS metric, '{estimator}' AS estimator, "
        f"round({value}, {digits}) AS estimate FROM t"
    )


# -- regression metrics -------------------------------------------------------

REG = {
    "rmse": "sqrt(avg((y - yhat) * (y - yhat)))",
    "rsq": "pow(corr(y, yhat), 2)",
    "mae": "avg(abs(y - yhat))",
    "mape": "avg(abs(y - yhat) / abs(y)) * 100",
}


def _register_regression(name, function):
    @query(f"metric_{name}", _metric_sql(name, REG[name], PRICES_SQL, digits=4))
    def _(spark, folder):
        return rounded(function(prices(spark, folder), "y", "yhat"), 4)


for _name, _function in (("rmse", M.rmse), ("rsq", M.rsq), ("mae", M.mae), ("mape", M.mape)):
    _register_regression(_name, _function)


# -- class metrics ------------------------------------------------------------

BINARY = {
    "accuracy": "avg(CASE WHEN y = yhat THEN 1.0e0 ELSE 0.0e0 END)",
    "precision": "count(*) FILTER (WHERE y = 'bad' AND yhat = 'bad') / count(*) FILTER (WHERE yhat = 'bad')",
    "recall": "count(*) FILTER (WHERE y = 'bad' AND yhat = 'bad') / count(*) FILTER (WHERE y = 'bad')",
}
BINARY["f_meas"] = f"2 * ({BINARY['precision']}) * ({BINARY['recall']}) / (({BINARY['precision']}) + ({BINARY['recall']}))"

KAPPA = (
    "WITH {cte}, n AS (SELECT count(*) AS n FROM t), a AS (SELECT y AS c, count(*) AS s FROM t GROUP BY 1), "
    "p AS (SELECT yhat AS c, count(*) AS q FROM t GROUP BY 1), e AS (SELECT sum(s * q) AS x FROM a JOIN p "
    "USING (c)), o AS (SELECT avg(CASE WHEN y = yhat THEN 1.0e0 ELSE 0.0e0 END) AS po FROM t) SELECT "
    "'kappa' AS metric, 'standard' AS estimator, round((po - x / (n * n)) / (1 - x / (n * n)), 6) AS "
    "estimate FROM n, e, o"
)


def _register_binary(name, function):
    @query(f"metric_{name}_binary", _metric_sql(name, BINARY[name], FLAGS_SQL))
    def _(spark, folder):
        return rounded(function(flags(spark, folder), "y", "yhat"))


for _name, _function in (
    ("accuracy", M.accuracy), ("precision", M.precision), ("recall", M.recall), ("f_meas", M.f_meas),
):
    _register_binary(_name, _function)


@query(
    "metric_precision_positive",
    _metric_sql(
        "precision",
        "count(*) FILTER (WHERE y = 'good' AND yhat = 'good') / count(*) FILTER (WHERE yhat = 'good')",
        FLAGS_SQL,
    ),
)
def _(spark, folder):
    return rounded(M.precision(flags(spark, folder), "y", "yhat", positive="good"))


@query("metric_kappa_binary", KAPPA.format(cte=FLAGS_SQL))
def _(spark, folder):
    return rounded(M.kappa(flags(spark, folder), "y", "yhat"))


PER_CLASS = (
    f"{KINDS_SQL}, a AS (SELECT y AS c, count(*) AS s, count(*) FILTER (WHERE y = yhat) AS tp FROM t GROUP BY 1), "
    "p AS (SELECT yhat AS c, count(*) AS q FROM t GROUP BY 1), m AS (SELECT avg(tp / q) AS pr, avg(tp / s) AS "
    "rc FROM a LEFT JOIN p USING (c))"
)


def _register_macro(name, value, function):
    sql = (
        f"WITH {PER_CLASS} SELECT '{name}' AS metric, 'standard' AS estimator, round({value}, 6) AS "
        "estimate FROM m"
    )

    @query(f"metric_{name}_macro", sql)
    def _(spark, folder):
        return rounded(function(kinds(spark, folder), "y", "yhat"))


_register_macro("precision", "pr", M.precision)
_register_macro("recall", "rc", M.recall)
_register_macro("f_meas", "2 * pr * rc / (pr + rc)", M.f_meas)


@query("metric_kappa_macro", KAPPA.format(cte=KINDS_SQL))
def _(spark, folder):
    return rounded(M.kappa(kinds(spark, folder), "y", "yhat"))


AUC_BINARY = (
    "r AS (SELECT y, rank() OVER (ORDER BY p_good) + (count(*) OVER (PARTITION BY p_good) - 1) / 2 AS rk FROM "
    "t), s AS (SELECT sum(rk) FILTER (WHERE y = 'good') AS rs, count(*) FILTER (WHERE y = 'good') AS p, "
    "count(*) FILTER (WHERE y <> 'good') AS q FROM r)"
)


@query(
    "metric_roc_auc_binary",
    f"WITH {FLAGS_SQL}, {AUC_BINARY} SELECT 'roc_auc' AS metric, 'binary' AS estimator, "
    "round((rs - p * (p + 1) / 2) / (p * q), 6) AS estimate FROM s",
)
def _(spark, folder):
    return rounded(M.roc_auc(flags(spark, folder), "y", "p_good", "good"))


# class scores from distances of the value to a centre per class
CENTRES = {"click": 5, "error": 20, "purchase": 60, "signup": 100, "view": 40}


def _with_scores(spark, folder):
    from mlscout.catalog.fixtures import table

    scores = F.array(*[1 / (1 + F.abs(F.col("value") - c)) for c in CENTRES.values()])
    return table(spark, folder, "events").select("event_id", F.col("event_type").alias("y"), scores.alias("p"))


HAND_TILL = (
    "WITH t AS (SELECT event_type AS y, value FROM events), c AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', {v})" for k, v in CENTRES.items())
    + ") v(k, centre)), x AS (SELECT a.k AS i, b.k AS j, t.y = a.k AS event, 1 / (1 + abs(value - a.centre)) AS s "
    "FROM c a JOIN c b ON a.k <> b.k JOIN t ON t.y IN (a.k, b.k)), r AS (SELECT i, j, event, rank() OVER "
    "(PARTITION BY i, j ORDER BY s) + (count(*) OVER (PARTITION BY i, j, s) - 1) / 2 AS rk FROM x), g AS "
    "(SELECT i, j, sum(rk) FILTER (WHERE event) AS rs, count(*) FILTER (WHERE event) AS p, count(*) FILTER "
    "(WHERE NOT event) AS q FROM r GROUP BY 1, 2) SELECT 'roc_auc' AS metric, 'multiclass' AS estimator, "
    "round(avg((rs - p * (p + 1) / 2) / (p * q)), 6) AS estimate FROM g"
)


@query("metric_roc_auc_hand_till", HAND_TILL)
def _(spark, folder):
    return rounded(M.roc_auc_hand_till(_with_scores(spark, folder), "y", "p", KIND_LEVELS))


@query(
    "metric_set_regression",
    f"WITH {PRICES_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS metric, 'standard' AS estimator, round({v}, 4) AS estimate FROM t"
        for n, v in REG.items()
    ),
)
def _(spark, folder):
    return rounded(M.metric_set(prices(spark, folder), "y", "yhat", "regression", extra=True), 4)


@query(
    "metric_set_binary",
    f"WITH {FLAGS_SQL}, {AUC_BINARY} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS metric, 'standard' AS estimator, round({v}, 6) AS estimate FROM t"
        for n, v in BINARY.items()
    )
    + " UNION ALL SELECT 'roc_auc', 'binary', round((rs - p * (p + 1) / 2) / (p * q), 6) FROM s",
)
def _(spark, folder):
    rows = flags(spark, folder).withColumn("p", F.array(1 - F.col("p_good"), "p_good"))
    return rounded(
        M.metric_set(rows, "y", "yhat", "classification", probability="p", levels=["bad", "good"])
    )


@query(
    "metric_set_by_group",
    "WITH t AS (SELECT l_linestatus, l_extendedprice AS y, 2100.0e0 * l_quantity * (1 - l_discount) AS yhat "
    "FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT l_linestatus, '{n}' AS metric, 'standard' AS estimator, round({REG[n]}, 4) AS estimate FROM t "
        "GROUP BY 1"
        for n in ("rmse", "rsq", "mae")
    ),
)
def _(spark, folder):
    from mlscout.catalog.fixtures import table

    rows = table(spark, folder, "lineitem").selectExpr(
        "l_linestatus", "l_extendedprice AS y", "2100.0e0 * l_quantity * (1 - l_discount) AS yhat"
    )
    return rounded(M.metric_set(rows, "y", "yhat", "regression", by=["l_linestatus"]), 4)


@query(
    "confusion",
    f"WITH {KINDS_SQL}, c AS (SELECT y AS actual, yhat AS predicted, count(*) AS n FROM t GROUP BY 1, 2), p AS "
    "(SELECT *, n * 100.0e0 / sum(n) OVER (PARTITION BY actual) AS pct FROM c) SELECT actual, predicted, n, "
    f"round(pct, 6) AS pct, n || ' (' || {text_sql('pct', 1)} || '%)' AS label FROM p",
)
def _(spark, folder):
    return rounded(M.confusion(kinds(spark, folder), "y", "yhat"))


@query(
    "class_distribution",
    f"WITH {KINDS_SQL}, a AS (SELECT y AS class, count(*) AS n FROM t GROUP BY 1), p AS (SELECT yhat AS class, "
    "count(*) AS n FROM t GROUP BY 1) SELECT class, coalesce(a.n, 0) AS n_actual, coalesce(p.n, 0) AS "
    "n_predicted FROM a FULL JOIN p USING (class)",
)
def _(spark, folder):
    return M.class_distribution(kinds(spark, folder), "y", "yhat")


# -- baselines ----------------------------------------------------------------


@query(
    "baseline_regression",
    "SELECT 'mean' AS strategy, round(sqrt(avg(pow(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 2))), "
    "4) AS baseline_rmse, 0.0e0 AS baseline_rsq FROM orders",
)
def _(spark, folder):
    from mlscout.catalog.fixtures import table

    return rounded(D.baseline_regression(table(spark, folder, "orders"), "o_totalprice"), 4)


@query(
    "baseline_classification",
    "WITH g AS (SELECT event_type AS class, count(*) AS n FROM events GROUP BY 1) SELECT 'mode' AS strategy, "
    "(SELECT class FROM g ORDER BY n DESC, class LIMIT 1) AS baseline_class, round(max(n) / sum(n), 6) AS "
    "baseline_accuracy FROM g",
)
def _(spark, folder):
    from mlscout.catalog.fixtures import table

    return rounded(D.baseline_classification(table(spark, folder, "events"), "event_type"))


@query(
    "baseline_lift_regression",
    f"WITH {PRICES_SQL}, v AS (SELECT sqrt(var_pop(y)) AS b, {REG['rmse']} AS m FROM t), l AS (SELECT *, "
    "(b - m) * 100 / b AS lift FROM v) SELECT round(b, 4) AS baseline_value, round(m, 4) AS model_value, "
    "round(lift, 4) AS lift, CASE WHEN lift > 50 THEN 'strong' WHEN lift > 20 THEN 'positive' WHEN lift > 5 "
    "THEN 'modest' WHEN lift > 0 THEN 'weak' ELSE 'worse_than_baseline' END AS band FROM l",
)
def _(spark, folder):
    rows = prices(spark, folder)
    metrics = M.metric_set(rows, "y", "yhat", "regression")
    return rounded(D.baseline_lift(metrics, D.baseline_regression(rows, "y"), "regression"), 4)


@query(
    "baseline_lift_classification",
    f"WITH {FLAGS_SQL}, g AS (SELECT y, count(*) AS n FROM t GROUP BY 1), v AS (SELECT (SELECT max(n) / sum(n) "
    f"FROM g) AS b, {BINARY['accuracy']} AS m FROM t), l AS (SELECT *, m - b AS lift FROM v) SELECT round(b, 6) "
    "AS baseline_value, round(m, 6) AS model_value, round(lift, 6) AS lift, CASE WHEN lift > 0.25 THEN 'strong' "
    "WHEN lift > 0.10 THEN 'positive' WHEN lift > 0.03 THEN 'modest' WHEN lift > 0 THEN 'weak' ELSE "
    "'worse_than_baseline' END AS band FROM l",
)
def _(spark, folder):
    rows = flags(spark, folder)
    metrics = M.metric_set(rows, "y", "yhat", "classification")
    return rounded(D.baseline_lift(metrics, D.baseline_classification(rows, "y"), "classification"))


# -- residuals ----------------------------------------------------------------


@query(
    "residuals",
    f"WITH {PRICES_SQL} SELECT l_orderkey, l_linenumber, round(yhat, 4) AS fitted, round(y - yhat, 4) AS residual "
    "FROM t",
)
def _(spark, folder):
    rows = D.residuals(prices(spark, folder), "y", "yhat")
    return rounded(rows.select("l_orderkey", "l_linenumber", "fitted", "residual"), 4)


JARQUE_BERA = (
    f"WITH {PRICES_SQL}, c AS (SELECT y - yhat - (SELECT avg(y - yhat) FROM t) AS d FROM t), m AS (SELECT "
    "count(*) AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM c), s AS (SELECT n, "
    "m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS excess FROM m), j AS (SELECT *, n / 6 * (skew * skew + "
    "excess * excess / 4) AS statistic FROM s)"
)


@query(
    "jarque_bera",
    f"{JARQUE_BERA} SELECT n, round(skew, 5) AS skew, round(excess, 5) AS excess, round(statistic, 2) AS "
    "statistic, round(exp(-statistic / 2), 5) AS p_value, exp(-statistic / 2) < 0.05 AS warning FROM j",
)
def _(spark, folder):
    found = D.jarque_bera(D.residuals(prices(spark, folder), "y", "yhat"))
    return rounded(found, 5).withColumn("statistic", F.round("statistic", 2))


@query(
    "normality_large",
    f"{JARQUE_BERA} SELECT 'inspect_qq_plot' AS test, round(statistic, 2) AS statistic, "
    "round(exp(-statistic / 2), 5) AS p_value, exp(-statistic / 2) < 0.05 AS warning FROM j WHERE n >= 5000",
)
def _(spark, folder):
    found = D.normality(D.residuals(prices(spark, folder), "y", "yhat"))
    return rounded(found, 2).withColumn("p_value", F.round("p_value", 5))


@query("normality_small")
def _(spark, folder):
    """Shapiro-Wilk on the customers' balances around their mean (fewer than 5000 at small scale)."""
    from mlscout.catalog.fixtures import table

    rows = table(spark, folder, "customer").select(F.col("c_acctbal").alias("residual"))
    return D.normality(rows)


@query(
    "homoscedasticity",
    f"WITH {PRICES_SQL}, m AS (SELECT median(yhat) AS mid FROM t), v AS (SELECT var_samp(y - yhat) FILTER "
    "(WHERE yhat <= mid) AS lo, var_samp(y - yhat) FILTER (WHERE yhat > mid) AS hi FROM t, m) SELECT "
    "round(lo, 2) AS var_low, round(hi, 2) AS var_high, round(hi / lo, 5) AS ratio, hi / lo > 2 OR hi / lo < 0.5 "
    "AS warning FROM v",
)
def _(spark, folder):
    found = D.homoscedasticity(D.residuals(prices(spark, folder), "y", "yhat"))
    return found.select(
        F.round("var_low", 2).alias("var_low"), F.round("var_high", 2).alias("var_high"),
        F.round("ratio", 5).alias("ratio"), "warning",
    )


@query(
    "qq_table",
    f"WITH {PRICES_SQL}, p AS (SELECT i / 10.0e0 AS prob FROM range(1, 10) r(i)) SELECT round(prob, 6) AS prob, "
    "round(CASE "
    + " ".join(
        f"WHEN prob < {i / 10 + 0.05} THEN {z}"
        for i, z in enumerate(
            [-1.2815515655, -0.8416212336, -0.5244005127, -0.2533471031, 0.0, 0.2533471031,
             0.5244005127, 0.8416212336, 1.2815515655], 1,
        )
    )
    + " END, 6)::DOUBLE AS theoretical, round(list_extract((SELECT quantile_cont(y - yhat, [0.1, 0.2, 0.3, 0.4, 0.5, "
    "0.6, 0.7, 0.8, 0.9]) FROM t), CAST(round(prob * 10) AS INTEGER)), 4) AS sample FROM p",
)
def _(spark, folder):
    found = D.qq_table(D.residuals(prices(spark, folder), "y", "yhat"), points=9)
    return found.select(
        F.round("prob", 6).alias("prob"), F.round("theoretical", 6).alias("theoretical"),
        F.round("sample", 4).alias("sample"),
    )


BINS = (
    f"WITH {PRICES_SQL}, e AS (SELECT min(yhat) AS lo, max(yhat) AS hi FROM t), b AS (SELECT "
    "CAST(least(floor((yhat - lo) / ((hi - lo) / 20)) + 1, 20) AS INTEGER) AS bin, yhat, y - yhat AS r FROM t, e) "
    "SELECT bin, count(*) AS n, round(avg(yhat), 4) AS mean_fitted, round(avg(r), 4) AS mean_residual, "
    "round(stddev_samp(r), 4) AS sd_residual FROM b GROUP BY 1"
)


@query("residual_bins", BINS)
def _(spark, folder):
    return rounded(D.residual_bins(D.residuals(prices(spark, folder), "y", "yhat"), 20), 4)


# -- overfitting and drift: the parts of the data stand in for folds and new rows


def _parts(spark, folder):
    """Early orders as folds, open lines as test rows."""
    from mlscout.catalog.fixtures import table

    return table(spark, folder, "lineitem").selectExpr(
        "l_linestatus AS part", "CAST(l_linenumber % 3 AS STRING) AS fold", "l_extendedprice AS y",
        "2100.0e0 * l_quantity * (1 - l_discount) AS yhat",
        "CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS c",
        "CASE WHEN l_extendedprice > 50000 THEN 'large' ELSE 'small' END AS chat",
    )


PARTS_SQL = (
    "t AS (SELECT l_linestatus AS part, CAST(l_linenumber % 3 AS VARCHAR) AS fold, l_extendedprice AS y, 2100.0e0 * "
    "l_quantity * (1 - l_discount) AS yhat, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS c, CASE "
    "WHEN l_extendedprice > 50000 THEN 'large' ELSE 'small' END AS chat FROM lineitem)"
)


def _cv_and_test(spark, folder, y, yhat, task_type):
    rows = _parts(spark, folder)
    cv = (
        M.metric_set(rows.filter("part = 'F'"), y, yhat, task_type, by=["fold"])
        .groupBy("metric")
        .agg(F.avg("estimate").alias("mean"))
    )
    return cv, M.metric_set(rows.filter("part = 'O'"), y, yhat, task_type)


@query(
    "overfit_regression",
    f"WITH {PARTS_SQL}, f AS (SELECT fold, {REG['rmse']} AS m FROM t WHERE part = 'F' GROUP BY 1), v AS (SELECT "
    f"(SELECT avg(m) FROM f) AS cv, {REG['rmse']} AS te FROM t WHERE part = 'O') SELECT 'rmse' AS metric, round(cv, "
    "4) AS cv_value, round(te, 4) AS test_value, round((te - cv) / cv, 4) AS change, CASE WHEN (te - cv) / cv > "
    "0.15 THEN 'overfit' WHEN (te - cv) / cv < -0.05 THEN 'unusual' ELSE 'good' END AS verdict FROM v",
)
def _(spark, folder):
    return rounded(D.overfit_regression(*_cv_and_test(spark, folder, "y", "yhat", "regression")), 4)


ACC = "avg(CASE WHEN c = chat THEN 1.0e0 ELSE 0.0e0 END)"


@query(
    "overfit_classification",
    f"WITH {PARTS_SQL}, f AS (SELECT fold, {ACC} AS m FROM t WHERE part = 'F' GROUP BY 1), v AS (SELECT (SELECT "
    f"avg(m) FROM f) AS cv, {ACC} AS te FROM t WHERE part = 'O') SELECT 'accuracy' AS metric, round(cv, 6) AS "
    "cv_value, round(te, 6) AS test_value, round(cv - te, 6) AS change, CASE WHEN cv - te > 0.05 THEN 'overfit' "
    "WHEN cv - te < -0.05 THEN 'unusual' ELSE 'good' END AS verdict FROM v",
)
def _(spark, folder):
    return rounded(
        D.overfit_classification(*_cv_and_test(spark, folder, "c", "chat", "classification"))
    )


@query(
    "drift_regression",
    f"WITH {PARTS_SQL}, a AS (SELECT {REG['rmse']} AS r1, {REG['rsq']} AS q1 FROM t WHERE part = 'F'), b AS (SELECT "
    f"{REG['rmse']} AS r2, {REG['rsq']} AS q2 FROM t WHERE part = 'O'), d AS (SELECT *, (r2 - r1) / r1 * 100 AS dr, "
    "(q2 - q1) / q1 * 100 AS dq FROM a, b) SELECT round(r1, 4) AS test_rmse, round(q1, 4) AS test_rsq, round(r2, 4) "
    "AS new_rmse, round(q2, 4) AS new_rsq, round(dr, 4) AS rmse_change_pct, round(dq, 4) AS rsq_change_pct, CASE "
    "WHEN abs(dr) < 10 THEN 'similar' WHEN dr > 0 THEN 'worse' ELSE 'better' END AS rmse_note, CASE WHEN abs(dq) < "
    "10 THEN 'generalizes' WHEN dq < 0 THEN 'degraded' ELSE 'unusually_better' END AS rsq_note, CASE WHEN abs(dr) "
    "< 15 AND abs(dq) < 15 THEN 'consistent' WHEN dr > 15 OR dq < -15 THEN 'overfit' ELSE 'unusually_better' END "
    "AS verdict FROM d",
)
def _(spark, folder):
    rows = _parts(spark, folder)
    test = M.metric_set(rows.filter("part = 'F'"), "y", "yhat", "regression")
    new = M.metric_set(rows.filter("part = 'O'"), "y", "yhat", "regression")
    return rounded(D.drift_regression(test, new), 4)


@query(
    "drift_classification",
    f"WITH {PARTS_SQL}, v AS (SELECT {ACC.replace('avg(', 'avg(', 1)} FILTER (WHERE part = 'F') AS a, {ACC} FILTER "
    "(WHERE part = 'O') AS b FROM t), d AS (SELECT *, (b - a) * 100 AS d FROM v) SELECT round(a, 6) AS "
    "test_accuracy, round(b, 6) AS new_accuracy, round(d, 6) AS change_points, CASE WHEN abs(d) < 5 THEN 'similar' "
    "WHEN d < 0 THEN 'worse' ELSE 'better' END AS note, CASE WHEN abs(d) < 5 THEN 'consistent' WHEN d < -5 THEN "
    "'overfit' ELSE 'unusually_better' END AS verdict FROM d",
)
def _(spark, folder):
    rows = _parts(spark, folder)
    test = M.metric_set(rows.filter("part = 'F'"), "c", "chat", "classification")
    new = M.metric_set(rows.filter("part = 'O'"), "c", "chat", "classification")
    return rounded(D.drift_classification(test, new))
