"""The path for large groups must give what the path for small ones gives."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mlscout.functions.hashing import row_hash
from mlscout.functions.ordering import (
    exact_quantiles,
    lowest_per_group,
    mark_lowest,
    part_medians,
    prefix_sums,
    replicate,
    select_hashes,
)

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def test_quantile_paths_agree(lineitem):
    names = ["l_quantity", "l_extendedprice", "l_orderkey", "l_discount"]
    small = exact_quantiles(lineitem, names, PROBS)
    assert exact_quantiles(lineitem, names, PROBS, max_cells=0) == small


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=60))
def test_refined_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = exact_quantiles(df, ["x"], [0.25, 0.5], max_cells=0)["x"]
    expected = np.quantile(np.array(values), [0.25, 0.5])
    assert found == pytest.approx(expected.tolist(), rel=1e-9, abs=1e-3)


def test_quantiles_with_missing_and_infinite(spark):
    rows = [(1.0, None), (2.0, None), (float("inf"), None), (float("nan"), None), (None, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    for cells in (10**6, 0):
        assert exact_quantiles(df, ["x", "y"], [0.5], max_cells=cells) == {"x": [1.5], "y": [None]}
        kept = exact_quantiles(df, ["x"], [0.5, 1.0], keep_infinite=True, max_cells=cells)
        assert kept == {"x": [2.0, float("inf")]}


def _quotas(df, group, share):
    return df.groupBy(group).agg(F.count("*").alias("_n")).withColumn(
        "_k", F.floor(F.col("_n") * share)
    )


def test_mark_lowest_paths_agree(lineitem):
    df = lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    quotas = _quotas(df, "l_returnflag", 0.6)
    key = ["l_orderkey", "l_linenumber"]
    small = mark_lowest(df, "l_returnflag", quotas, key, 1, "flag")
    large = mark_lowest(df, "l_returnflag", quotas, key, 1, "flag", max_group_rows=10)
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()


@pytest.mark.parametrize("limit", [10**6, 10])
def test_mark_lowest_is_exact_when_copies_share_a_key(lineitem, limit):
    # a third and more of the rows are copies of each other here
    df = lineitem.select("l_returnflag", "l_linestatus")
    quotas = _quotas(df, "l_returnflag", 0.5)
    taken = lowest_per_group(df, "l_returnflag", quotas, ["l_linestatus"], 1, max_group_rows=limit)
    got = {r[0]: r[1] for r in taken.groupBy("l_returnflag").count().collect()}
    assert got == {r[0]: r["_k"] for r in quotas.collect()}
    marked = mark_lowest(df, "l_returnflag", quotas, ["l_linestatus"], 1, "f", max_group_rows=limit)
    assert marked.drop("f").exceptAll(df).isEmpty() and marked.count() == df.count()


def test_column_names_cannot_collide(lineitem):
    df = lineitem.select(
        F.col("l_orderkey").alias("n"), F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("g")
    )
    quotas = _quotas(df, "g", 0.5)
    for limit in (10**6, 10):
        marked = mark_lowest(df, "g", quotas, ["n", "k"], 1, "f", max_group_rows=limit)
        assert marked.columns == ["n", "k", "g", "f"]
        assert marked.filter("f").count() == quotas.agg(F.sum("_k")).first()[0]


def test_prefix_sum_paths_agree(lineitem):
    df = lineitem.groupBy("l_returnflag", "l_extendedprice").agg(F.count("*").alias("n"))
    small = prefix_sums(df, ["l_returnflag"], "l_extendedprice", ["n"])
    large = prefix_sums(df, ["l_returnflag"], "l_extendedprice", ["n"], max_group_rows=500)
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()
    whole = df.groupBy("l_extendedprice").agg(F.sum("n").alias("n"))
    a = prefix_sums(whole, [], "l_extendedprice", ["n"])
    b = prefix_sums(whole, [], "l_extendedprice", ["n"], max_group_rows=500)
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() == whole.count()


def test_replicate_spreads_many_copies(spark):
    df = spark.createDataFrame([("a", 3), ("b", 250_001)], "x string, n int")
    out = replicate(df, F.col("n"), 250_001)
    assert {r.x: r["count"] for r in out.groupBy("x").count().collect()} == {"a": 3, "b": 250_001}
    assert out.columns == ["x", "n"]


def test_sums_of_groups_known_to_be_large_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(0, 1000, 1, 4).selectExpr("id", "id % 7 AS n").mapInPandas(seen, "id long, n long")
    out = prefix_sums(rows, [], "id", ["n"], max_group_rows=100, group_rows=1000)
    last = out.orderBy(F.desc("id")).first()
    assert last.n_before == sum(i % 7 for i in range(999))
    assert made.value == 1000


def test_hash_ranks_equal_a_sort(spark):
    rows = spark.range(5000).select(
        (F.col("id") % 3).cast("int").alias("_g"), row_hash(["id"], 1).alias("_hash")
    ).filter("_g < 2 OR _hash % 2 = 0")
    rows = rows.unionByName(rows.filter("_g = 1"))
    found = select_hashes(rows, {0: 17, 1: 1001, 2: 0})
    for g, rank in ((0, 17), (1, 1001), (2, 0)):
        values = sorted(r[0] for r in rows.filter(f"_g = {g}").select("_hash").collect())
        value = values[rank]
        assert found[g] == (value, values.index(value), values.count(value))


def test_part_medians_are_those_of_the_parts(spark):
    wide = spark.range(900).select(
        (F.col("id") % 3).cast("int").alias("fold"),
        F.when(F.col("id") % 7 != 0, F.sin("id") * F.exp(F.col("id") / 50)).alias("a"),
        F.when(F.col("id") % 5 < 3, F.lit(float("inf"))).otherwise(F.col("id") % 4).alias("b"),
        F.when(F.col("id") % 3 == 1, F.col("id").cast("double")).alias("own"),
        F.lit(None).cast("double").alias("never"),
        (F.col("id") % 2).cast("int").alias("flag"),
    )
    names, parts = ["a", "b", "own", "never", "flag"], [None, 0, 1, 2]
    found = part_medians(wide, names, "fold", parts)
    for part in parts:
        rows = wide if part is None else wide.filter(F.col("fold") != part)
        expected = exact_quantiles(rows, names, [0.5], keep_infinite=True)
        assert {c: [found[c, part]] for c in names} == expected


def test_a_guess_from_the_size_finds_a_hash_and_a_wrong_one_is_noticed(spark):
    rows = spark.range(4000).select(
        (F.col("id") % 2).cast("int").alias("_g"), row_hash(["id"], 9).alias("_hash")
    )
    heavy = rows.unionByName(spark.range(5000).select(F.lit(1).alias("_g"), F.lit(77).cast("long").alias("_hash")))
    for df in (rows, heavy):
        sizes = {r._g: r["count"] for r in df.groupBy("_g").count().collect()}
        wanted = {g: int(0.75 * n) for g, n in sizes.items()}
        assert select_hashes(df, wanted, sizes) == select_hashes(df, wanted)
