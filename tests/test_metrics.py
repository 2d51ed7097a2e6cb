import itertools
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mlscout.operators import metrics as M


def _value(df):
    rows = df.collect()
    return rows[0].estimate if rows else None


def test_rsq_is_squared_correlation(spark):
    df = spark.createDataFrame([(float(v), 2.0 * v + 3) for v in range(10)], "y double, p double")
    assert _value(M.rsq(df, "y", "p")) == pytest.approx(1)
    flat = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "y double, p double")
    assert M.rsq(flat, "y", "p").isEmpty()
    assert {r.metric for r in M.metric_set(flat, "y", "p", "regression").collect()} == {"rmse", "mae"}


def test_mape_leaves_zeros_out(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "y double, p double")
    assert _value(M.mape(df, "y", "p")) == pytest.approx(50)


def test_macro_skips_a_class_that_is_never_called(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(rows, "y string, p string")
    assert _value(M.precision(df, "y", "p")) == pytest.approx((0.5 + 0.5) / 2)
    assert _value(M.recall(df, "y", "p")) == pytest.approx((0.5 + 1 + 0) / 3)


def test_binary_positive_is_the_first_level(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, p int")
    assert _value(M.recall(df, "y", "p")) == pytest.approx(0.5)
    assert _value(M.recall(df, "y", "p", positive=1)) == pytest.approx(1.0)


def _auc(pairs):
    wins = total = 0
    for (e1, s1), (e2, s2) in itertools.product(pairs, pairs):
        if e1 and not e2:
            total += 1
            wins += 1 if s1 > s2 else 0.5 if s1 == s2 else 0
    return wins / total if total else None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 5)), min_size=2, max_size=40))
def test_auc_against_brute_force(spark, pairs):
    df = spark.createDataFrame([(e, float(s)) for e, s in pairs], "y boolean, s double")
    expected = _auc(pairs)
    for limit in (10**6, 2):
        found = _value(M.roc_auc(df, "y", "s", True, max_group_rows=limit))
        assert found == (None if expected is None else pytest.approx(expected))


def test_perfectly_reversed_ranking(spark):
    df = spark.createDataFrame([("n", 0.9), ("n", 0.8), ("p", 0.2), ("p", 0.1)], "y string, s double")
    assert _value(M.roc_auc(df, "y", "s", "p")) == 0
    assert _value(M.roc_auc(df, "y", "s", "n")) == 1


def test_hand_till_against_brute_force(spark):
    rng = random.Random(4)
    levels = ["a", "b", "c"]
    rows = [(rng.choice(levels), [round(rng.random(), 1) for _ in levels]) for _ in range(60)]
    df = spark.createDataFrame(rows, "y string, p array<double>")
    parts = []
    for i, j in itertools.permutations(range(3), 2):
        pairs = [(y == levels[i], p[i]) for y, p in rows if y in (levels[i], levels[j])]
        parts.append(_auc(pairs))
    for limit in (10**6, 3):
        found = _value(M.roc_auc_hand_till(df, "y", "p", levels, max_group_rows=limit))
        assert found == pytest.approx(sum(parts) / len(parts))
    # a class that no row has leaves the others alone, and a null group is a group
    more = df.withColumn("g", F.when(F.rand(3) < 2, F.lit(None).cast("string")))
    found = M.roc_auc_hand_till(more, "y", "p", [*levels, "none"], ["g"]).collect()
    assert [(r["g"], r["estimate"]) for r in found] == [(None, pytest.approx(sum(parts) / len(parts)))]
    plan = M.roc_auc_hand_till(df, "y", "p", levels, group_rows=60)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2  # one order per score, one look-up of K rows


def test_confusion_sums_to_n_and_missing_rows_do_not_count(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), ("b", None)], "y string, p string")
    assert M.confusion(df, "y", "p").agg(F.sum("n")).first()[0] == 2
    assert _value(M.accuracy(df, "y", "p")) == 0.5


def test_groups_are_evaluated_apart(spark):
    rows = [(g, "a" if i % 2 else "b", "a" if (i % 2) == g else "b") for g in (0, 1) for i in range(4)]
    df = spark.createDataFrame(rows, "g int, y string, p string")
    found = {r.g: r.estimate for r in M.accuracy(df, "y", "p", by=["g"]).collect()}
    assert found == {0: 0.0, 1: 1.0}


def test_kappa(spark):
    rows = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15
    df = spark.createDataFrame(rows, "y string, p string")
    assert _value(M.kappa(df, "y", "p")) == pytest.approx(0.4)
    assert not math.isnan(_value(M.f_meas(df, "y", "p")))


def test_hand_till_counts_few_classes_in_columns_and_many_in_rows(spark, monkeypatch):
    levels = ["a", "b", "c"]
    random.seed(5)
    rows = [
        (i % 2, random.choice(levels), [random.randrange(5) / 4, random.random(), 0.5]) for i in range(300)
    ] + [(2, "a", [0.1, 0.2, 0.7]), (2, "b", [0.1, 0.3, 0.6]), (0, "other", [1.0, 0.0, 0.0]), (1, "a", None)]
    df = spark.createDataFrame(rows, "g int, y string, p array<double>")
    found = M.roc_auc_hand_till(df, "y", "p", levels, ["g"])
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    few = {r.g: r.estimate for r in found.collect()}
    monkeypatch.setattr(M, "FEW_LEVELS", 0)
    many = {r.g: r.estimate for r in M.roc_auc_hand_till(df, "y", "p", levels, ["g"]).collect()}
    assert few.keys() == many.keys() == {0, 1, 2}
    assert all(few[g] == pytest.approx(many[g], rel=1e-12) for g in few)
