"""The masked Gram matrix against numpy, pair by pair."""

import numpy as np
import pytest

from mlscout.operators.gram import block_state, correlation, merged, pair_correlations


def brute(x):
    p = x.shape[1]
    r, n = np.full((p, p), np.nan), np.zeros((p, p))
    for i in range(p):
        for j in range(p):
            both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            a, b = x[both, i], x[both, j]
            n[i, j] = len(a)
            if len(a) > 1 and (a != a[0]).any() and (b != b[0]).any():
                r[i, j] = np.corrcoef(a, b)[0, 1]
    return n, r


def gappy(seed, rows=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 9))
    x[:, 1] += 2 * x[:, 0]
    x[:, 2] = 1.7e9 + 30 * x[:, 2]  # seconds since an epoch
    x[:, 3] = 0.1
    x[:, 4] = np.nan
    x[:, 5] *= 1e-9
    x[rng.random(x.shape) < 0.3] = np.nan
    x[::50, 6] = np.inf
    x[5:, 7] = np.nan
    x[:, 8] = np.where(np.isnan(x[:, 0]), x[:, 8], 123456.789)  # constant where column 0 is there
    return x


@pytest.mark.parametrize("cuts", [[], [1, 2, 3], [7, 120, 121, 390], list(range(1, 400))])
def test_states_merge_to_the_whole(cuts):
    x = gappy(len(cuts))
    total = None
    for part in np.split(x, cuts):
        found = block_state(part)
        total = found if total is None else merged(total, found)
    n, r = brute(x)
    assert (total[0] == n).all()
    np.testing.assert_allclose(correlation(total), r, atol=2e-6)


def test_sixty_four_columns_in_one_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64)) @ rng.normal(size=(64, 64))
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"v{i}" for i in range(64)]
    rows = [[None if v != v else float(v) for v in row] for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    df.repartition(5).write.parquet(str(tmp_path / "t"))
    found = pair_correlations(spark.read.parquet(str(tmp_path / "t")), names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    n, r = brute(x)
    got = {(v["column_a"], v["column_b"]): (v["n"], v["r"]) for v in found.collect()}
    assert len(got) == 64 * 63 // 2
    for (a, b), (count, value) in got.items():
        i, j = int(a[1:]), int(b[1:])
        assert count == n[i, j] and value == pytest.approx(r[i, j], abs=1e-9)


def test_no_rows_and_equal_names(spark):
    df = spark.createDataFrame([], "a double, b double, n double")
    got = pair_correlations(df, ["a", "b", "n"]).collect()
    assert [(r["n"], r["r"]) for r in got] == [(0, None)] * 3
