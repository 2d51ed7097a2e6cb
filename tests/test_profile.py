import warnings

import pytest
from pyspark.sql import functions as F

from mlscout.operators.issues import NO_STEPS, find_issues, prep_steps
from mlscout.operators.profile import (
    profile,
    profile_categorical,
    profile_histogram,
    profile_missing,
    profile_numeric,
    profile_top_values,
)
from mlscout.operators.recommend import filter_compatible, is_compatible, recommend
from mlscout.operators.task import detect_task, needs_regularization


def _missing(df):
    return {r["column"]: r.pct_missing for r in profile_missing(df).collect()}


def test_missing_share(spark):
    rows = [(1.0, 1.0, 1.0), (2.0, None, 2.0), (None, 3.0, 3.0), (4.0, float("nan"), 4.0), (5.0, 5.0, 5.0)]
    assert _missing(spark.createDataFrame(rows, "x double, y double, z double")) == {
        "x": 20.0, "y": 40.0, "z": 0.0,
    }


def test_numeric_summary_of_odd_columns(spark):
    inf = float("inf")
    rows = [(1.0, None, inf), (2.0, None, -inf), (float("nan"), None, inf), (inf, None, inf)]
    df = spark.createDataFrame(rows, "x double, empty double, endless double")
    found = {r["column"]: r for r in profile_numeric(df).collect()}
    x = found["x"]
    assert (x["mean"], x.sd, x["min"], x["max"]) == (None, None, None, None)
    assert (x.median, x.n_unique, x.n_infinite) == (1.5, 2, 1)
    assert (found["empty"].median, found["empty"].n_unique, found["empty"].n_infinite) == (None, 0, 0)
    assert (found["endless"].median, found["endless"].n_unique, found["endless"].n_infinite) == (None, 0, 4)


def test_large_integer_keys_stay_distinct(spark):
    df = spark.createDataFrame([(2**60,), (2**60 + 1,)], "k bigint")
    assert profile_numeric(df).first().n_unique == 2


def test_sketches_are_close(lineitem):
    exact = {r["column"]: r for r in profile_numeric(lineitem).collect()}
    near = {r["column"]: r for r in profile_numeric(lineitem, exact=False).collect()}
    for c, e in exact.items():
        assert near[c].n_unique == pytest.approx(e.n_unique, rel=0.15)
        assert near[c].median == pytest.approx(e.median, rel=0.05, abs=1.0)


def test_categorical_counts_missing_as_a_value(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "x string")
    assert profile_categorical(df).first().n_unique == 3
    assert profile_categorical(df, exact=False).first().n_unique == 3
    top = profile_top_values(df)
    assert [(r["rank"], r.value, r.n) for r in top.orderBy("rank").collect()] == [(1, "b", 2), (2, "a", 1)]
    # a column beyond the limit is told, not left out
    told = profile_top_values(df, max_unique=2).collect()
    assert [(r["column"], r["rank"], r["n"]) for r in told] == [(top.first()["column"], None, None)]
    assert told[0]["value"].startswith("too many values to show: ")


def test_ties_are_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "x string")
    assert [r.value for r in profile_top_values(df).orderBy("rank").collect()] == ["c", "a", "b"]


def test_profile_drops_nested_and_refuses_empty(spark, data):
    found = profile(spark.read.parquet(f"{data}/embeddings.parquet"))
    assert found.dropped_columns == ["embedding"]
    assert found.structure.first().n_cols == 2
    with pytest.raises(ValueError, match="empty"):
        profile(spark.createDataFrame([], "x int"))


def test_one_value_histogram(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r.bin, r.n) for r in profile_histogram(df, 4).collect()] == [(1, 2)]


def test_issue_rules(spark):
    rows = [(i, float(i), None if i < 8 else float(i), 1000 + i / 100, f"v{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "id int, x double, gap double, flat double, name string")
    issues = find_issues(profile(df)).collect()
    assert [(r["column"], r.issue_type, r.severity) for r in issues] == [
        ("gap", "high_missing", "high"),
        ("name", "high_cardinality", "medium"),
        ("flat", "near_zero_variance", "low"),
    ]
    assert issues[0].description == "66.7% missing values"
    assert prep_steps(find_issues(profile(df))).count() == 3
    clean = spark.createDataFrame([(1, 2), (3, 5)], "x int, y int")
    assert prep_steps(find_issues(profile(clean))).first().step == NO_STEPS


def test_mean_zero_column_is_never_flat(spark):
    df = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    assert find_issues(profile(df)).count() == 0


# -- task ---------------------------------------------------------------------


def _target(spark, values, kind):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"y {kind}, x int")
        return detect_task(df, "y")


def test_numeric_targets(spark):
    assert _target(spark, [0, 1] * 10, "int").task_subtype == "binary"
    sure = _target(spark, [i % 4 for i in range(100)], "int")
    assert (sure.task_subtype, sure.confidence) == ("multiclass", "high")
    likely = _target(spark, [i % 5 for i in range(100)], "int")
    assert (likely.task_subtype, likely.confidence) == ("multiclass", "medium")
    assert _target(spark, [i % 10 for i in range(100)], "int").task_type == "regression"
    assert _target(spark, [i % 20 for i in range(500)], "int").task_type == "classification"
    assert _target(spark, [i % 21 for i in range(500)], "int").task_type == "regression"
    assert _target(spark, [i % 3 + 0.5 for i in range(100)], "double").task_type == "regression"


def test_text_targets_and_imbalance(spark):
    assert _target(spark, ["Yes", "No"] * 5, "string").task_subtype == "binary"
    assert _target(spark, list("ABC") * 4, "string").task_subtype == "multiclass"
    for rare, expected in ((49, "severe"), (50, "moderate"), (199, "moderate"), (200, None)):
        task = _target(spark, ["a"] * (1000 - rare) + ["b"] * rare, "string")
        assert task.imbalance == expected


def test_refused_targets(spark):
    df = spark.createDataFrame(
        [(None, 1, True, "2020-01-01"), (None, 1, False, "2020-01-02")],
        "empty int, same int, flag boolean, day string",
    ).withColumn("day", F.to_date("day"))
    for target, message in (
        ("empty", "entirely missing"), ("same", "one distinct"), ("day", "date or time"),
        ("flag", "numeric or text"), ("nope", "not found"),
    ):
        with pytest.raises(ValueError, match=message):
            detect_task(df, target)


def test_recommendations(spark):
    task = _target(spark, [0, 1] * 50, "int")
    assert needs_regularization(task) is False
    rows = recommend(spark, task).collect()
    assert [r.priority for r in rows] == sorted(r.priority for r in rows)
    assert [r.engine for r in rows][:2] == ["glmnet", "ranger"]
    assert {r.engine for r in rows} == {
        "glmnet", "ranger", "xgboost", "kernlab", "naivebayes", "kknn", "rpart",
    }
    table = spark.createDataFrame([("naivebayes",), ("lm",), ("mystery",)], "engine string")
    kept = {r.engine for r in filter_compatible(table, "regression").collect()}
    assert kept == {"lm", "mystery"}
    with pytest.warns(UserWarning):
        assert is_compatible("mystery", "regression")
