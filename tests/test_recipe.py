import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mlscout.operators.recipe import (
    AsNumber, DropCorrelated, DropNearZeroVariance, Dummy, FittedRecipe, ImputeMedian, IntegerEncode,
    MinMax, NovelLevel, PoolRare, Recipe, Standardize, correlated_columns, correlation_matrix, default_recipe,
    recipe_from_options,
)


def _types(spark, shares):
    rows = [(v, float(i)) for v, n in shares.items() for i in range(n)]
    return spark.createDataFrame(rows, "c string, y double")


def test_pooling_boundary(spark):
    df = _types(spark, {"a": 50, "b": 41, "five": 5, "four": 4})
    fitted = Recipe("y", [PoolRare()]).fit(df)
    assert fitted.steps[0][1]["keep"] == {"c": ["a", "b", "five"]}
    new = spark.createDataFrame([("a",), ("four",), ("unseen",), (None,)], "c string")
    assert [r.c for r in fitted.apply(new).collect()] == ["a", "OTHER", "OTHER", None]
    assert Recipe("y", [PoolRare()]).fit(_types(spark, {"a": 5, "b": 5})).steps[0][1]["keep"] == {}


def test_dummy_reference_and_unseen(spark):
    df = _types(spark, {"b": 3, "a": 3, "c": 3})
    fitted = Recipe("y", [NovelLevel(), Dummy()]).fit(df)
    assert fitted.features == ["c_b", "c_c"]
    new = spark.createDataFrame([("a",), ("b",), ("zzz",)], "c string")
    assert [tuple(r) for r in fitted.apply(new).collect()] == [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]
    coded = Recipe("y", [IntegerEncode()]).fit(df).apply(new)
    assert [r.c for r in coded.collect()] == [1, 2, 0]


def test_too_many_levels_must_be_pooled(spark):
    df = spark.range(1500).select(F.col("id").cast("string").alias("c"), F.lit(1.0).alias("y"))
    with pytest.raises(ValueError, match="pooled"):
        Recipe("y", [Dummy()]).fit(df)
    fitted = Recipe("y", [NovelLevel(), PoolRare(), Dummy()]).fit(df)
    assert len(fitted.features) == 1


def test_default_recipe_standardises_training_rows(lineitem):
    rows = lineitem.select(
        "l_quantity", "l_discount", "l_returnflag", "l_shipdate", "l_extendedprice",
        F.lit(3).alias("constant"), (F.col("l_quantity") * -2).alias("twice"),
    )
    fitted = default_recipe("l_extendedprice").fit(rows)
    assert "constant" not in fitted.features
    assert ("twice" in fitted.features) != ("l_quantity" in fitted.features)
    out = fitted.apply(rows)
    assert "l_shipdate" in out.columns
    moments = out.agg(
        *[f(c).alias(f"{n}_{c}") for c in fitted.features for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    ).first()
    for c in fitted.features:
        assert moments[f"m_{c}"] == pytest.approx(0, abs=1e-8)
        assert moments[f"s_{c}"] == pytest.approx(1, abs=1e-8)


def test_fit_ignores_rows_it_is_not_given(lineitem):
    train = lineitem.filter("l_orderkey % 4 > 0").select("l_quantity", "l_returnflag", "l_extendedprice")
    test = lineitem.filter("l_orderkey % 4 = 0").select("l_quantity", "l_returnflag", "l_extendedprice")
    fitted = default_recipe("l_extendedprice").fit(train)
    shifted = test.withColumn("l_quantity", F.col("l_quantity") + 1000)
    again = default_recipe("l_extendedprice").fit(train)
    assert again.to_json() == fitted.to_json()
    assert fitted.apply(shifted).agg(F.avg("l_quantity")).first()[0] > 10


def test_recipe_survives_json(lineitem):
    rows = lineitem.select("l_quantity", "l_returnflag", "l_extendedprice")
    fitted = default_recipe("l_extendedprice").fit(rows)
    back = FittedRecipe.from_json(fitted.to_json())
    assert back.apply(rows).exceptAll(fitted.apply(rows)).isEmpty()
    assert back.features == fitted.features


def test_recipe_plan_is_one_generated_stage_without_python(lineitem):
    rows = lineitem.select("l_quantity", "l_returnflag", "l_extendedprice")
    plan = default_recipe("l_extendedprice").fit(rows).apply(rows)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "Python" not in physical and "Exchange" not in physical and "Window" not in physical
    # Catalyst keeps an expression that several columns use in a projection of its own
    assert physical.count("*(1) Project") == physical.count("Project") and "*(2)" not in physical


def test_scaling_of_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0)], "x double, c double")
    out = Recipe("_", [MinMax()]).fit(df).apply(df).collect()
    assert [(r.x, r.c) for r in out] == [(0.0, 0.0), (None, 0.0), (1.0, 0.0)]
    filled = Recipe("_", [ImputeMedian(), Standardize()]).fit(df).apply(df).collect()
    assert [(r.x, r.c) for r in filled] == [(-1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]


def test_imputed_moments_equal_a_second_pass(spark):
    rows = [(float(v),) if v % 3 else (None,) for v in range(50)]
    df = spark.createDataFrame(rows, "x double")
    fitted = Recipe("_", [ImputeMedian(), Standardize()]).fit(df)
    filled = Recipe("_", [ImputeMedian()]).fit(df).apply(df)
    mean, sd = filled.agg(F.avg("x"), F.stddev_samp("x")).first()
    assert fitted.steps[1][1]["moments"]["x"] == pytest.approx([mean, sd])


def test_near_zero_variance(spark):
    df = spark.range(1000).selectExpr(
        "id", "CASE WHEN id % 40 = 0 THEN 1 ELSE 0 END AS rare", "id % 2 AS even", "1 AS one"
    )
    assert Recipe("_", [DropNearZeroVariance()]).fit(df).features == ["id", "even"]


def test_correlated_columns_rule():
    matrix = [[1, 0.95, 0.1], [0.95, 1, 0.5], [0.1, 0.5, 1]]
    assert correlated_columns(["a", "b", "c"], matrix, 0.9) == ["b"]
    assert correlated_columns(["a", "b"], [[1, 0.9], [0.9, 1]], 0.9) == []
    nan = float("nan")
    assert correlated_columns(["a", "b"], [[1, nan], [nan, 1]], 0.9) == []


def test_other_kinds_become_numbers(spark):
    df = spark.sql("SELECT true AS b, DATE'1970-01-02' AS d, array(1) AS a, 'x' AS s")
    out = Recipe("_", [AsNumber()]).fit(df).apply(df)
    assert out.columns == ["b", "d", "s"] and tuple(out.first()) == (1.0, 86400.0, "x")


def test_options(lineitem):
    rows = lineitem.select("l_quantity", "l_returnflag", "l_extendedprice")
    kept = recipe_from_options("l_extendedprice", "keep", "keep_cat", "none").fit(rows)
    assert kept.features == ["l_quantity", "l_returnflag"]
    ranged = recipe_from_options("l_extendedprice", scaling="minmax").fit(rows).apply(rows)
    assert ranged.agg(F.min("l_quantity"), F.max("l_quantity")).first()[:] == (0.0, 1.0)
    with pytest.raises(ValueError):
        recipe_from_options("l_extendedprice", encoding="magic")
    assert DropCorrelated().fit(rows.select("l_quantity"), _context()) == {"columns": []}


def _context():
    from mlscout.operators.recipe import Context

    return Context([])


def test_correlations_use_the_rows_of_each_pair(spark):
    """A column without values, or with gaps, leaves the other pairs alone."""
    rows = spark.createDataFrame(
        [(1.0, 2.0, None, None), (2.0, 4.0, 3.0, None), (3.0, 6.0, 1.0, None), (4.0, 9.0, 2.0, None)],
        "a double, b double, c double, d double",
    )
    found = correlation_matrix(rows, ["a", "b", "c", "d"])
    assert found[0][1] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 4, 6, 9])[0, 1])
    assert found[0][2] == found[2][0] == pytest.approx(np.corrcoef([2, 3, 4], [3, 1, 2])[0, 1])
    assert all(math.isnan(found[i][3]) for i in range(3))
    assert DropCorrelated().fit(rows, _context())["columns"] in (["a"], ["b"])
