"""Correlations of all column pairs from one scan: a masked Gram matrix that merges.

Each task turns its rows, block by block, into matrix products of the values and of the mask
of finite values. They give, for every ordered pair of columns, the rows where both are
finite, and over these the mean and centred squares of the first column and the co-moment of
the two. Such states merge exactly like those of single columns, so they are added up in a
tree of tasks, and p x p numbers are left whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_CELLS = 1 << 20  # values of one matrix product
FAN_IN = 64  # most tasks of the middle level of the tree
FLAT = 1e-13  # a column whose spread is below this share of its mean is constant

State = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def block_state(x: np.ndarray) -> State:
    """(n, mean, squares, products) of one block of rows; NaN and infinities are absent.

    Entry (i, j) of ``mean`` and ``squares`` is about column i over rows where j is there too.
    """
    there = np.isfinite(x)
    mask = there.astype(np.float64)
    # values are taken from near their mean; a constant column becomes exactly 0
    first = np.where(there.any(0), x[there.argmax(0), np.arange(x.shape[1])], 0.0)
    z = np.where(there, x - first, 0.0)
    centre = z.sum(0) / np.maximum(mask.sum(0), 1)
    z = np.where(there, z - centre, 0.0)
    n = mask.T @ mask
    sums, squares, products = z.T @ mask, (z * z).T @ mask, z.T @ z
    per = np.maximum(n, 1)
    centred = squares - sums * sums / per
    centred[centred <= 1e-13 * squares] = 0.0  # what rounding leaves of equal values
    mean = np.where(n > 0, (first + centre)[:, None] + sums / per, 0.0)
    return n, mean, centred, products - sums * sums.T / per


def merged(a: State, b: State) -> State:
    n = a[0] + b[0]
    per = np.maximum(n, 1)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    weight = a[0] * b[0] / per
    mean = (a[1] * a[0] + b[1] * b[0]) / per
    return n, mean, a[2] + b[2] + gap * gap * weight, a[3] + b[3] + gap * gap.T * weight


def correlation(state: State) -> np.ndarray:
    """r of every pair; NaN for a constant side or pairs never there together."""
    n, mean, squares, products = state
    size = np.where(squares > n * (FLAT * np.abs(mean)) ** 2, squares, 0.0)
    both = np.sqrt(size) * np.sqrt(size.T)
    r = np.full(n.shape, np.nan)
    np.divide(products, both, out=r, where=(n > 1) & (both > 0))
    return np.clip(r, -1.0, 1.0)


def _packed(state: State | None) -> Iterator[pa.RecordBatch]:
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([np.stack(state).tobytes()], pa.binary())], ["state"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        step = max(1, BLOCK_CELLS // max(1, batch.num_columns))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns])
            found = block_state(block.astype(np.float64))
            total = found if total is None else merged(total, found)
    yield from _packed(total)


def _added(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = tuple(np.frombuffer(raw).reshape(4, width, width))
                total = found if total is None else merged(total, found)
        yield from _packed(total)

    return run


def gram_state(values: DataFrame) -> DataFrame:
    """One row ``state`` (none for an empty table) of the double columns of ``values``."""
    width = len(values.columns)
    states = values.mapInArrow(_states, "state binary")
    # two levels: no task takes more than its share of all tasks' states, one after another
    fan = min(FAN_IN, values.sparkSession.sparkContext.defaultParallelism)
    middle = states.repartition(fan).mapInArrow(_added(width), "state binary")
    return middle.repartition(1).mapInArrow(_added(width), "state binary")


def pair_correlations(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_a, column_b, n, r) of every pair of columns, from one scan; ``names`` are shown."""
    width, shown = len(names), list(names)
    rows, columns = np.triu_indices(width, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = np.zeros((width, width)), np.full((width, width), np.nan)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                state = tuple(np.frombuffer(raw).reshape(4, width, width))
                n, r = state[0], correlation(state)
        found = r[rows, columns]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shown[i] for i in rows], pa.string()),
                pa.array([shown[j] for j in columns], pa.string()),
                pa.array(n[rows, columns].astype(np.int64)),
                pa.array(found, mask=np.isnan(found)),
            ],
            ["column_a", "column_b", "n", "r"],
        )

    return gram_state(values).mapInArrow(run, "column_a string, column_b string, n long, r double")


def _second_moments(shifts: np.ndarray, scales: np.ndarray):
    """Products of the shifted and scaled values, gaps and indicators of a block, per fold."""
    width = len(shifts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            step = max(1, BLOCK_CELLS // (batch.num_columns + width + 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                fold = part.column(0).to_numpy(zero_copy_only=False)
                columns = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns[1:]]
                x = np.column_stack(columns) if columns else np.zeros((part.num_rows, 0))
                gap = np.isnan(x[:, :width])
                z = np.where(gap, 0.0, (x[:, :width] - shifts) / scales)
                z = np.column_stack([np.ones(part.num_rows), z, gap, x[:, width:]])
                for f in np.unique(fold).tolist():
                    own = z[fold == f]
                    total[f] = total.get(f, 0.0) + own.T @ own
        yield from _fold_rows(total)

    return run


def _fold_rows(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if total:
        states = [m.tobytes() for m in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(states, pa.binary())], ["fold", "state"])


def _fold_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for fold, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[fold] = total.get(fold, 0.0) + np.frombuffer(raw)
    yield from _fold_rows(total)


def fold_second_moments(
    values: DataFrame, shifts: Sequence[float], scales: Sequence[float]
) -> dict[int, np.ndarray]:
    """Per fold the sums of products of (1, values, gaps, indicators), from one scan.

    The first column of ``values`` is the fold's number, then come as many double columns as
    there are shifts, which may have gaps, then 0/1 columns. Matrices of folds add up.
    """
    schema = "fold long, state binary"
    make = _second_moments(np.array(shifts, np.float64), np.array(scales, np.float64))
    fan = min(FAN_IN, values.sparkSession.sparkContext.defaultParallelism)
    states = values.mapInArrow(make, schema).repartition(fan).mapInArrow(_fold_sums, schema)
    size = 2 * len(shifts) + len(values.columns) - len(shifts)
    return {
        r["fold"]: np.frombuffer(bytes(r["state"])).reshape(size, size)
        for r in states.repartition(1).mapInArrow(_fold_sums, schema).collect()
    }
