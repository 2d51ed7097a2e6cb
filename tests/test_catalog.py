"""The driver contract on the smallest data, and the shape of plans."""

import duckdb
import pytest

import __spark_entry__ as contract
from mlscout.catalog import fixtures as fx
from mlscout.operators.metrics import metric_set
from mlscout.operators.profile import profile_missing, profile_top_values

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
SAMPLE = [
    "profile_numeric", "find_issues", "clean_pipeline", "recipe_default_dummies", "metric_set_binary",
    "metric_roc_auc_hand_till", "split_rows_stratified", "knn_exact", "oversample_rows",
]


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["column", "issue_type", "description", "severity", "position"]
    assert found.count() >= 1


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 120


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = contract.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    names = ", ".join(f'"{c}"' for c in columns)
    expected = con.execute(f"SELECT {names} FROM ({contract.oracle_sql()[name]})").fetchall()
    assert got == sorted(str(tuple(r)) for r in expected)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, data):
    rows = fx.table(spark, data, "lineitem").select("l_returnflag", "l_tax")
    plan = _plan(profile_missing(rows))
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in plan and "Python" not in plan
    top = _plan(profile_top_values(rows))
    assert "WindowGroupLimit" in top and "Expand" not in top
    metrics = _plan(metric_set(fx.kinds(spark, data), "y", "yhat", "classification"))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SortMergeJoin"):
        assert bad not in metrics
