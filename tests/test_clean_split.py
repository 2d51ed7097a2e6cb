import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mlscout.functions.hashing import row_hash
from mlscout.operators.clean import (
    cap_iqr, clean, drop_missing_columns, drop_missing_rows, impute, oversample, undersample,
)
from mlscout.operators.split import FOLD_SEED, assign_folds, split


@pytest.fixture(scope="module")
def gaps(lineitem):
    return lineitem.selectExpr(
        "l_orderkey", "l_linenumber",
        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "CASE WHEN l_orderkey % 5 < 3 THEN double('NaN') ELSE l_tax END AS l_tax",
        "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag", "l_linestatus",
    ).cache()


def test_impute_leaves_nothing_missing(gaps):
    out = impute(gaps)
    assert drop_missing_rows(out).count() == gaps.count()
    assert out.columns == gaps.columns


def test_impute_keeps_integers_unless_the_median_is_fractional(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (None, None), (6, 4)], "a int, b int")
    out = impute(df)
    assert dict(out.dtypes) == {"a": "int", "b": "int"}
    half = impute(spark.createDataFrame([(1,), (2,), (None,)], "a int"))
    assert dict(half.dtypes) == {"a": "double"}
    assert sorted(r.a for r in half.collect()) == [1.0, 1.5, 2.0]


def test_drop_missing_columns_spares_the_target(gaps):
    assert "l_tax" not in drop_missing_columns(gaps, "l_linestatus").columns
    assert "l_tax" in drop_missing_columns(gaps, "l_tax").columns


def test_capping(spark):
    # capping moves no quartile, so a second time nothing changes
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 1000]] + [(None,)], "x double")
    once = cap_iqr(df)
    assert sorted(v.x for v in cap_iqr(once).collect() if v.x is not None) == sorted(
        v.x for v in once.collect() if v.x is not None
    )
    assert once.filter("x IS NULL").count() == 1
    assert once.agg(F.max("x")).first()[0] == pytest.approx(14.5)


@pytest.mark.parametrize("limit", [10**6, 20])
def test_balancing(spark, data, limit):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    before = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    up = oversample(labels, "toxic", key="doc_id", max_group_rows=limit)
    assert {r["count"] for r in up.groupBy("toxic").count().collect()} == {max(before.values())}
    assert labels.exceptAll(up).isEmpty()  # no row is lost
    down = undersample(labels, "toxic", key="doc_id", max_group_rows=limit)
    assert {r["count"] for r in down.groupBy("toxic").count().collect()} == {min(before.values())}
    assert down.exceptAll(labels).isEmpty()


def test_balancing_drops_rows_without_a_class(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "y string, x int")
    assert oversample(df, "y").count() == 4
    assert undersample(df, "y").count() == 2


def test_clean_guards(spark, gaps):
    with pytest.raises(ValueError, match="rows remain"):
        clean(spark.createDataFrame([(1, "a")], "x int, y string"), "y")
    with pytest.raises(ValueError, match="unknown strategy"):
        clean(gaps, "l_linestatus", "magic")
    out = clean(gaps, "l_linestatus", "remove_cols", "cap_iqr", "undersample", key=["l_orderkey", "l_linenumber"])
    assert "l_tax" not in out.columns
    assert len({r["count"] for r in out.groupBy("l_linestatus").count().collect()}) == 1


def test_split_partitions_rows(lineitem):
    key = ["l_orderkey", "l_linenumber"]
    for task, target in (("regression", "l_extendedprice"), ("classification", "l_returnflag")):
        parts = split(lineitem, target, task, key=key)
        both = parts.train.unionByName(parts.test)
        assert both.exceptAll(lineitem).isEmpty() and lineitem.exceptAll(both).isEmpty()
    assert parts.stratified
    for r in parts.rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("is_train").alias("t")).collect():
        assert r.t == int(r.n * 0.75)


def test_split_falls_back_on_a_single_row_class(spark):
    df = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 99)], "y string, x int")
    with pytest.warns(UserWarning):
        parts = split(df, "y", "classification", key="x")
    assert not parts.stratified and parts.message


def test_folds(lineitem):
    key = ["l_orderkey", "l_linenumber"]
    for options in ({}, {"stratify": "l_returnflag"}, {"stratify": "l_returnflag", "max_group_rows": 100}):
        folded = assign_folds(lineitem, 4, key, **options)
        assert folded.count() == lineitem.count()
        assert {r.fold for r in folded.select("fold").distinct().collect()} == {0, 1, 2, 3}
    even = assign_folds(lineitem, 4, key, stratify="l_returnflag")
    for r in even.groupBy("l_returnflag").pivot("fold").count().collect():
        assert max(r[1:]) - min(r[1:]) <= 1


def test_folds_are_dealt_in_hash_order_with_one_shuffle_of_rows(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("c"))
    order = Window.partitionBy("c").orderBy(row_hash(["id"], FOLD_SEED))
    wanted = rows.select("id", ((F.row_number().over(order) - 1) % 4).alias("wanted"))
    for limit in (100, 1_000_000):
        folded = assign_folds(rows, 4, "id", stratify="c", max_group_rows=limit)
        assert folded.join(wanted, "id").filter("fold = wanted").count() == 3000
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3


def test_folds_of_rows_that_share_a_key(spark):
    rows = spark.range(2000).selectExpr("'one' AS k", "id % 2 AS c", "id % 50 AS x")
    folded = assign_folds(rows, 5, "k", stratify="c", max_group_rows=30)
    counts = folded.groupBy("c", "fold").count().collect()
    assert len(counts) == 10 and {r["count"] for r in counts} == {200}
