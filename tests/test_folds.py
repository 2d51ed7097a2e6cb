"""Recipes of all training parts from shared statistics, against recipes fitted part by part.

Moments of a column of some 1.7e9 agree to seven digits, as its mean is known to 1e-16 of that.
"""

import pytest
from pyspark.sql import functions as F

from mlscout.operators import folds, recipe as recipes
from mlscout.operators.folds import fit_parts
from mlscout.operators.recipe import (
    AsNumber, DropColumns, Dummy, DropCorrelated, DropMissingColumns, DropNearZeroVariance, ImputeMedian, ImputeMode,
    MinMax, OmitMissing, Recipe, Standardize, default_recipe,
)
from mlscout.functions import ordering


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1200).select(
        "id", (F.col("id") % 5 + 1).cast("int").alias("_fold"),
        F.when(F.col("id") % 7 != 0, F.sin("id") * 3).alias("a"),
        (F.sin("id") * 6 + F.cos(F.col("id") * 3) * 0.1).alias("near_a"),
        (F.cos("id") + 1.7e9).alias("far"),
        F.when(F.col("id") % 5 == 2, F.lit(4.0)).otherwise(F.lit(4.0)).alias("constant"),
        F.lit(None).cast("double").alias("never"),
        (F.col("id") % 2 == 0).alias("flag"),
        F.when(F.col("id") % 11 != 0, F.element_at(F.array(*map(F.lit, "xxxyyz")), (F.col("id") % 6 + 1).cast("int")))
        .alias("text"),
        F.when(F.col("id") % 97 == 0, F.lit("rare")).when(F.col("id") % 3 == 0, "OTHER").otherwise("often").alias("pooled"),
        F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("three"),
        (F.cos(F.col("id") * 2) + F.col("id") / 300).alias("y"),
    )
    return df.repartition(4).cache()


PARTS = {None: 1200} | {f: 960 for f in range(1, 6)}


def _close(a, b):
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_close(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(_close, a, b))
    return a == pytest.approx(b, rel=1e-7, abs=1e-6) if isinstance(a, float) else a == b


@pytest.mark.parametrize("steps", [
    None,
    [AsNumber(), ImputeMode(), Dummy(one_hot=True), ImputeMedian(), MinMax(), DropCorrelated(threshold=0.6)],
    [OmitMissing(), Dummy(), Standardize(), DropCorrelated()],
    # the spread of the constant column is rounding noise in the single fit
    [AsNumber(), DropColumns(["constant"]), DropMissingColumns(), ImputeMedian(), Standardize(), ImputeMedian(), DropNearZeroVariance()],
    [AsNumber(), Dummy(), DropCorrelated()],
])
@pytest.mark.parametrize("cells", [None, 10])
def test_parts_equal_single_fits(rows, steps, cells, monkeypatch):
    if cells:
        for module in (recipes, ordering):
            monkeypatch.setattr(module, "MAX_CELLS", cells)
    used = default_recipe("y", ["id", "_fold"]) if steps is None else Recipe("y", steps, ["id", "_fold"])
    found = fit_parts(used, rows, "_fold", PARTS)
    for part in (None, 2):
        alone = used.fit(rows if part is None else rows.filter(F.col("_fold") != part), PARTS[part])
        assert [n for n, _ in found[part].steps] == [n for n, _ in alone.steps]
        for (name, a), (_, b) in zip(found[part].steps, alone.steps):
            assert _close(a, b), [(n, x, b[k].get(n)) for k in a if isinstance(a[k], dict) for n, x in a[k].items()
                                  if not _close(x, b[k].get(n))]
        assert found[part].features == alone.features


def test_scans_do_not_grow_with_the_folds(spark, rows):
    jobs = {}
    for n in (2, 5):
        some = rows.withColumn("_fold", F.col("_fold") % n)
        parts = {None: 1200} | {f: 1 for f in range(n)}
        spark.sparkContext.setJobGroup(f"folds-{n}", "")
        try:
            fit_parts(default_recipe("y", ["id", "_fold"]), some, "_fold", parts)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds-{n}"))
    assert 0 < jobs[5] == jobs[2]


def test_correlations_come_from_the_products(rows, monkeypatch):
    """None of the parts of a default recipe computes a matrix of its own."""
    monkeypatch.setattr(recipes, "correlation_matrix", lambda *a: pytest.fail("a matrix of one part"))
    found = fit_parts(default_recipe("y", ["id", "_fold"]), rows, "_fold", PARTS)
    assert all(dict(f.steps)["drop_correlated"]["columns"] for f in found.values())
    assert folds.fold_second_moments


def test_medians_of_many_rows_meet_a_value_once_for_all_parts(rows, monkeypatch):
    steps = [ImputeMedian()]
    expected = fit_parts(Recipe("y", steps, ["_fold"]), rows, "_fold", PARTS)
    monkeypatch.setattr(folds, "MAX_CELLS", 0, raising=False)
    monkeypatch.setattr(folds, "exact_quantiles", None)  # a column per column and part
    found = fit_parts(Recipe("y", steps, ["_fold"]), rows, "_fold", PARTS)
    assert {p: f.steps for p, f in found.items()} == {p: f.steps for p, f in expected.items()}
