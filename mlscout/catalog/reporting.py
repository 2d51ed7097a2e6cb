"""Comparison tables, findings, metric cards and chart tables as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlscout.catalog.evaluation import BINARY, BINS, REG
from mlscout.catalog.fixtures import (
    FLAGS_SQL, PRICES_SQL, flags, hash2_sql, prices, rounded, table, text_sql,
)
from mlscout.functions.hashing import HASH_RANGE
from mlscout.operators.metrics import metric_set
from mlscout.plans import findings as N
from mlscout.plans.train import comparison_table, rank_models

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# three fixed pricing rules play the part of three trained engines
RULES = {
    "glmnet": "2100.0e0 * l_quantity",
    "ranger": "2100.0e0 * l_quantity * (1 - l_discount)",
    "rpart": "CASE WHEN l_quantity > 25 THEN 80000.0e0 ELSE 27000.0e0 END",
}


def _rule_metrics(spark, folder):
    rows = table(spark, folder, "lineitem")
    out = None
    for seq, (engine, rule) in enumerate(RULES.items()):
        scored = rows.selectExpr("l_extendedprice AS y", f"{rule} AS yhat")
        part = metric_set(scored, "y", "yhat", "regression").withColumns(
            {"model": F.lit(engine), "seq": F.lit(seq)}
        )
        out = part if out is None else out.unionByName(part)
    return out


RULES_SQL = " UNION ALL ".join(
    f"SELECT '{engine}' AS model, {seq} AS seq, {REG['rmse']} AS rmse, {REG['rsq']} AS rsq, {REG['mae']} AS mae "
    f"FROM (SELECT l_extendedprice AS y, {rule} AS yhat FROM lineitem)"
    for seq, (engine, rule) in enumerate(RULES.items())
)
RANKED_SQL = f"WITH w AS ({RULES_SQL}), k AS (SELECT *, row_number() OVER (ORDER BY rsq DESC, seq) AS rank FROM w)"


@query(
    "comparison_table",
    f"WITH w AS ({RULES_SQL}) SELECT model, seq, round(rmse, 4) AS rmse, round(rsq, 4) AS rsq, round(mae, 4) AS mae "
    "FROM w",
)
def _(spark, folder):
    return rounded(comparison_table(_rule_metrics(spark, folder)), 4)


@query(
    "comparison_rank",
    f"{RANKED_SQL} SELECT model, seq, round(rmse, 4) AS rmse, round(rsq, 4) AS rsq, round(mae, 4) AS mae, "
    "CAST(rank AS INTEGER) AS rank FROM k",
)
def _(spark, folder):
    return rounded(rank_models(comparison_table(_rule_metrics(spark, folder)), "regression"), 4)


@query(
    "comparison_lines",
    f"{RANKED_SQL} SELECT CAST(rank AS INTEGER) AS rank, model, rank || '. ' || CASE model WHEN 'glmnet' THEN "
    "'Lasso/Ridge Regression' WHEN 'ranger' THEN 'Random Forest' ELSE 'Decision Tree' END || ': R-squared = ' || "
    + text_sql("rsq", 3)
    + " AS line FROM k",
)
def _(spark, folder):
    ranked = rank_models(comparison_table(_rule_metrics(spark, folder)), "regression")
    return N.explain_comparison(ranked, "regression")


def _price_metrics(spark, folder):
    return metric_set(prices(spark, folder), "y", "yhat", "regression")


def _flag_metrics(spark, folder):
    rows = flags(spark, folder).withColumn("p", F.array(1 - F.col("p_good"), "p_good"))
    return metric_set(rows, "y", "yhat", "classification", probability="p", levels=["bad", "good"])


PRICE_M = f"WITH {PRICES_SQL}, m AS (SELECT {REG['rmse']} AS rmse, {REG['rsq']} AS rsq, {REG['mae']} AS mae FROM t)"
FLAG_M = (
    f"WITH {FLAGS_SQL}, r AS (SELECT y, rank() OVER (ORDER BY p_good) + (count(*) OVER (PARTITION BY p_good) - 1) / "
    "2 AS rk FROM t), u AS (SELECT (sum(rk) FILTER (WHERE y = 'good') - count(*) FILTER (WHERE y = 'good') * "
    "(count(*) FILTER (WHERE y = 'good') + 1) / 2) / (count(*) FILTER (WHERE y = 'good') * count(*) FILTER (WHERE "
    f"y <> 'good')) AS auc FROM r), m AS (SELECT {BINARY['accuracy']} AS acc, {BINARY['precision']} AS pr, "
    f"{BINARY['recall']} AS rc, {BINARY['f_meas']} AS f1, (SELECT auc FROM u) AS auc FROM t)"
)


def band(value, bands, lowest, op=">="):
    cases = " ".join(f"WHEN {value} {op} {limit} THEN '{name}'" for limit, name in bands)
    return f"CASE {cases} ELSE '{lowest}' END"


def finding(section, item, value, band_sql="NULL", advice="NULL"):
    return (
        f"SELECT '{section}' AS section, '{item}' AS item, round({value}, 4) AS value, "
        f"CAST({band_sql} AS VARCHAR) AS band, CAST({advice} AS VARCHAR) AS advice FROM m"
    )


@query(
    "findings_regression",
    f"{PRICE_M} "
    + " UNION ALL ".join(
        [
            finding("metrics", "rsq", "rsq", band("rsq", N.RSQ_BANDS, N.RSQ_LOWEST)),
            finding("metrics", "rmse", "rmse"),
            finding("metrics", "mae", "mae"),
            finding("practical", "rsq", "rsq", band("rsq", N.RSQ_TIERS, N.LOWEST_TIER)),
        ]
    ),
)
def _(spark, folder):
    return rounded(N.regression_findings(_price_metrics(spark, folder)), 4)


@query(
    "findings_classification",
    f"{FLAG_M} "
    + " UNION ALL ".join(
        [
            finding("metrics", "accuracy", "acc", band("acc", N.ACCURACY_BANDS, N.ACCURACY_LOWEST)),
            finding("metrics", "precision", "pr"),
            finding("metrics", "recall", "rc"),
            finding("practical", "accuracy", "acc", band("acc", N.ACCURACY_TIERS, N.LOWEST_TIER)),
        ]
    ),
)
def _(spark, folder):
    return rounded(N.classification_findings(_flag_metrics(spark, folder)), 4)


@query(
    "findings_pr_balance",
    f"{FLAG_M} "
    + finding(
        "metrics", "precision_recall", "pr - rc",
        "CASE WHEN pr > rc + 0.1 THEN 'conservative' WHEN rc > pr + 0.1 THEN 'aggressive' ELSE 'balanced' END",
    ),
)
def _(spark, folder):
    return rounded(N.pr_balance(_flag_metrics(spark, folder)), 4)


@query(
    "findings_f1_auc",
    f"{FLAG_M} "
    + finding("metrics", "f_meas", "f1", band("f1", N.F1_BANDS, "needs improvement", ">"))
    + " UNION ALL "
    + finding("metrics", "roc_auc", "auc", band("auc", N.AUC_BANDS, "random")),
)
def _(spark, folder):
    return rounded(N.f1_auc_bands(_flag_metrics(spark, folder)), 4)


# importance stand-in: strength of the link of each numeric column with the price
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "l_partkey"]


def _importance(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rows.agg(
        *[F.abs(F.corr(F.col(c).cast("double"), "l_extendedprice")).alias(c) for c in FEATURES]
    ).unpivot([], FEATURES, "variable", "importance")


IMPORTANCE_SQL = "imp AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, abs(corr({c}, l_extendedprice)) AS importance FROM lineitem" for c in FEATURES
) + ")"


@query(
    "findings_importance",
    f"WITH {IMPORTANCE_SQL}, k AS (SELECT variable, importance, row_number() OVER (ORDER BY importance DESC, variable) "
    "AS rank, round(importance * 100 / sum(importance) OVER (), 1) AS share FROM imp) SELECT CAST(rank AS INTEGER) AS "
    "rank, 'importance' AS section, variable AS item, share AS value, CASE WHEN share >= 50 THEN 'dominant' END AS band, "
    "CASE WHEN share >= 50 THEN 'check_that_it_is_known_beforehand' END AS advice FROM k WHERE rank <= 5",
)
def _(spark, folder):
    return N.importance_findings(_importance(spark, folder))


@query(
    "importance_chart",
    f"WITH {IMPORTANCE_SQL} SELECT variable, round(importance, 6) AS importance FROM imp ORDER BY 2 DESC, 1 LIMIT 4",
)
def _(spark, folder):
    return rounded(N.importance_chart(_importance(spark, folder), 4))


def _remark(item, value, test, advice):
    return (
        f"SELECT 'remark' AS section, '{item}' AS item, {value} AS value, CAST(NULL AS VARCHAR) AS band, "
        f"'{advice}' AS advice FROM m WHERE {test}"
    )


TOP_SQL = (
    "(SELECT 'key_finding', variable, round(importance * 100 / sum(importance) OVER (), 1), CASE WHEN importance * 100 / "
    "sum(importance) OVER () >= 50 THEN 'dominant' END, CASE WHEN importance * 100 / sum(importance) OVER () >= 50 THEN "
    "'check_that_it_is_known_beforehand' END FROM imp ORDER BY importance DESC, variable LIMIT 1)"
)


@query(
    "recommendations",
    f"SELECT section, item, round(value, 4) AS value, band, advice FROM ({FLAG_M}, {IMPORTANCE_SQL} "
    + " UNION ALL ".join(
        [
            _remark("accuracy", "acc", "acc < 0.8", "errors_are_frequent"),
            _remark("precision", "pr", "pr < rc - 0.1", "false_alarms_prevail"),
            _remark("recall", "rc", "rc < pr - 0.1", "misses_prevail"),
            _remark("roc_auc", "auc", "auc < 0.7", "scores_order_rows_poorly"),
            TOP_SQL,
        ]
    )
    + ")",
)
def _(spark, folder):
    found = N.recommendations(_flag_metrics(spark, folder), _importance(spark, folder), "classification")
    return rounded(found, 4)


def _steps_sql(cte, test, engines):
    rows = ["('good', 1, 'score_new_rows', NULL)"]
    rows += [f"('improve', {i}, 'compare_engine', '{e}')" for i, e in enumerate(engines, 1)]
    return (
        f"{cte} SELECT state, seq, step, suggested FROM (VALUES {', '.join(rows)}) v(state, seq, step, suggested), m "
        f"WHERE state = CASE WHEN {test} THEN 'good' ELSE 'improve' END"
    )


@query("next_steps_regression", _steps_sql(PRICE_M, "rsq >= 0.7", ["glmnet", "xgboost"]))
def _(spark, folder):
    return N.next_steps(_price_metrics(spark, folder), "rpart", "regression")


@query("next_steps_classification", _steps_sql(FLAG_M, "acc >= 0.85", ["glmnet", "rpart", "xgboost"]))
def _(spark, folder):
    return N.next_steps(_flag_metrics(spark, folder), "ranger", "classification")


@query(
    "metric_cards_regression",
    f"{PRICE_M} SELECT 1 AS seq, 'primary' AS role, 'R-squared' AS name, {text_sql('rsq', 3)} AS value, CASE WHEN rsq >= "
    "0.7 THEN 'green' WHEN rsq >= 0.5 THEN 'yellow' WHEN rsq >= 0.3 THEN 'orange' ELSE 'red' END AS color FROM m "
    f"UNION ALL SELECT 2, 'secondary', 'RMSE', {text_sql('rmse', 2)}, NULL FROM m UNION ALL SELECT 3, 'secondary', "
    f"'MAE', {text_sql('mae', 2)}, NULL FROM m",
)
def _(spark, folder):
    return N.metric_cards(_price_metrics(spark, folder), "regression")


@query(
    "metric_cards_classification",
    f"{FLAG_M} SELECT 1 AS seq, 'primary' AS role, 'Accuracy' AS name, {text_sql('acc * 100', 1)} || '%' AS value, CASE "
    "WHEN acc >= 0.85 THEN 'green' WHEN acc >= 0.75 THEN 'yellow' WHEN acc >= 0.65 THEN 'orange' ELSE 'red' END AS "
    f"color FROM m UNION ALL SELECT 2, 'secondary', 'Precision', {text_sql('pr * 100', 1)} || '%', NULL FROM m UNION "
    f"ALL SELECT 3, 'secondary', 'Recall', {text_sql('rc * 100', 1)} || '%', NULL FROM m UNION ALL SELECT 4, "
    f"'secondary', 'AUC', {text_sql('auc', 3)}, NULL FROM m",
)
def _(spark, folder):
    return N.metric_cards(_flag_metrics(spark, folder), "classification")


@query(
    "traffic_light",
    "WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 101 / 100.0e0 END AS v FROM "
    "events) SELECT event_id, CASE WHEN v IS NULL THEN 'gray' WHEN v >= 0.7 THEN 'green' WHEN v >= 0.5 THEN 'yellow' "
    "WHEN v >= 0.3 THEN 'orange' ELSE 'red' END AS rsq, CASE WHEN v IS NULL THEN 'gray' WHEN v >= 0.85 THEN 'green' "
    "WHEN v >= 0.75 THEN 'yellow' WHEN v >= 0.65 THEN 'orange' ELSE 'red' END AS accuracy FROM t",
)
def _(spark, folder):
    rows = table(spark, folder, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 101 / 100.0e0 END AS v"
    )
    return rows.select(
        "event_id", N.traffic_light(F.col("v"), "rsq").alias("rsq"),
        N.traffic_light(F.col("v"), "accuracy").alias("accuracy"),
    )


@query(
    "pred_vs_actual",
    f"WITH {PRICES_SQL} SELECT round(y, 4) AS actual, round(yhat, 4) AS predicted FROM t WHERE "
    f"{hash2_sql('l_orderkey', 'l_linenumber', 123)} < floor(500.0e0 / (SELECT count(*) FROM t) * {HASH_RANGE})",
)
def _(spark, folder):
    points = N.pred_vs_actual(
        prices(spark, folder), "y", "yhat", 500, ["l_orderkey", "l_linenumber"]
    )
    return rounded(points, 4)


@query("residual_chart", BINS)
def _(spark, folder):
    return rounded(N.residual_chart(prices(spark, folder), "y", "yhat", 20), 4)
