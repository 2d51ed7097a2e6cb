"""Exact k-nearest-neighbour join without pairing every row with every other.

Training points are grouped into cells around pivots. The triangle inequality bounds
the k-th neighbour distance of a test point from per-cell summaries, so a test point
visits only the cells that can hold a neighbour. Cells and their visitors are cut into
blocks of bounded size; each pair of blocks keeps only its k best, and a final top-k
per test point merges them. Copies of a point are collapsed first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlscout.session import cut_lineage

BLOCK_ROWS = 10_000
MAX_PIVOTS = 512
POINTS_PER_PIVOT = 10_000
STORED_ROWS = 1_000_000  # beyond it, intermediate rows are written instead of recomputed
CHUNK_CELLS = 1 << 21  # distances held at once by a task
SEED = 123
NEAREST, FARTHEST = 1e-6, 1 - 1e-6  # scaled distances are held between these


def _optimal(u: Column, rank: Column, size: Column, k: int) -> Column:
    """Samworth's weights of least asymptotic error, by rank and number of dimensions."""
    step = 1 + 2 / size
    fall = size / (2 * F.pow(F.lit(float(k)), 2 / size))
    return (1 + size / 2 - fall * (F.pow(rank, step) - F.pow(rank - 1, step))) / k


def _gaussian(u: Column, rank: Column, size: Column, k: int) -> Column:
    """The normal density, scaled so that neighbour k + 1 lies at its 1 / (2k + 2) quantile."""
    edge = NormalDist().inv_cdf(1 / (2 * (k + 1)))
    return F.exp(-F.pow(u * edge, 2) / 2) / math.sqrt(2 * math.pi)


#: Weight of a neighbour from its distance as a share of that of neighbour k + 1, its rank,
#: the number of dimensions and k.
KERNELS: dict[str, Callable[[Column, Column, Column, int], Column]] = {
    "rectangular": lambda u, rank, size, k: F.lit(1.0),
    "triangular": lambda u, rank, size, k: 1 - u,
    "epanechnikov": lambda u, rank, size, k: 0.75 * (1 - u * u),
    "biweight": lambda u, rank, size, k: 15 / 16 * F.pow(1 - u * u, F.lit(2.0)),
    "triweight": lambda u, rank, size, k: 35 / 32 * F.pow(1 - u * u, F.lit(3.0)),
    "cos": lambda u, rank, size, k: math.pi / 4 * F.cos(u * math.pi / 2),
    "inv": lambda u, rank, size, k: 1 / u,
    "gaussian": _gaussian,
    "rank": lambda u, rank, size, k: (k + 1 - rank).cast("double"),
    "optimal": _optimal,
}


def kernel_weight(k: int, kernel: str, by: str = "point") -> Column:
    """Weight of the k nearest in a table of :func:`nearest_neighbours` for k + 1, else null.

    Neighbour k + 1 scales the distances; with fewer points the last one does. Where all
    distances are 0 every neighbour is as near as can be. Weights are above 0. ``by`` is the
    column that tells points apart.
    """
    if kernel not in KERNELS:
        raise ValueError(f"no kernel {kernel!r}; there are {', '.join(KERNELS)}")
    if k < 1:
        raise ValueError("k must be at least 1")
    reach = F.greatest(F.max("distance").over(Window.partitionBy(by)), F.lit(NEAREST))
    scaled = F.least(F.greatest(F.col("distance") / reach, F.lit(NEAREST)), F.lit(FARTHEST))
    weight = KERNELS[kernel](scaled, F.col("rank"), F.size("point").cast("double"), k)
    return F.when(F.col("rank") <= k, weight)


def weighted_neighbours(
    train: DataFrame, test: DataFrame, k: int, kernel: str = "optimal", **options: int
) -> DataFrame:
    """:func:`nearest_neighbours` with a ``weight`` for each of the k."""
    # dealt by visitor like the ranks before them: no shuffle
    weight = kernel_weight(k, kernel, "visitor")
    found = _nearest(train, test, k + 1, **options)
    return found.withColumn("weight", weight).filter(F.col("weight").isNotNull()).drop("visitor")


def _rows(points: pa.ListArray) -> np.ndarray:
    """Points of equal length as the rows of one matrix."""
    if isinstance(points, pa.ChunkedArray):
        points = points.combine_chunks()
    return points.flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())


def nearest_neighbours(
    train: DataFrame,
    test: DataFrame,
    k: int,
    *,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
    points_per_pivot: int = POINTS_PER_PIVOT,
) -> DataFrame:
    """``(point, rank, key, distance)``: the k training rows nearest to each distinct point.

    ``train`` has ``key`` and ``point`` (array of double), ``test`` has ``point``; no
    value may be missing. Order: Euclidean distance, then key.
    """
    found = _nearest(
        train, test, k, block_rows=block_rows, max_pivots=max_pivots, points_per_pivot=points_per_pivot
    )
    return found.drop("visitor")


def _nearest(
    train: DataFrame,
    test: DataFrame,
    k: int,
    *,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
    points_per_pivot: int = POINTS_PER_PIVOT,
) -> DataFrame:
    """:func:`nearest_neighbours` with a number per distinct point, ``visitor``, and dealt by it."""
    spark = train.sparkSession
    key_type = train.schema["key"].dataType.simpleString()
    # a point can serve at most its k lowest keys as neighbours
    copies = Window.partitionBy("point").orderBy("key")
    points = (
        train.select("key", "point")
        .withColumn("_copy", F.row_number().over(copies))
        .filter(F.col("_copy") <= k)
        .drop("_copy")
    )
    # stored, so that the numbers stay: what a block finds for a point travels under its number
    visitors = cut_lineage(
        test.select("point").distinct().withColumn("visitor", F.monotonically_increasing_id())
    )

    total = points.count()
    if total == 0:
        raise ValueError("no training point")
    size = min(max_pivots, max(1, total // points_per_pivot))
    pivots = [
        list(r.point)
        for r in points.orderBy(F.xxhash64("key", F.lit(SEED))).limit(size).select("point").collect()
    ]

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.asarray(pivots)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            own = _rows(batch.column("point"))
            cell = np.zeros(len(own), dtype="int32")
            best = np.full(len(own), np.inf)
            for i, centre in enumerate(centres):
                distance = np.sqrt(((own - centre) ** 2).sum(axis=1))
                nearer = distance < best
                cell[nearer] = i
                best[nearer] = distance[nearer]
            columns = [batch.column("key"), batch.column("point"), pa.array(cell), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "point", "cell", "to_pivot"])

    in_cells = points.mapInArrow(
        to_cells, f"key {key_type}, point array<double>, cell int, to_pivot double"
    )
    if total > STORED_ROWS:
        in_cells = cut_lineage(in_cells)  # read three times below
    # k distances and two numbers per pivot: bounded by the pivot count
    nearest = Window.partitionBy("cell").orderBy("to_pivot")
    inner = (
        in_cells.select("cell", "to_pivot")
        .withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= k)
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list("to_pivot")).alias("inner"))
    )
    stats = in_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("to_pivot").alias("radius"))
    cells = {r.cell: r for r in stats.join(inner, "cell").collect()}
    numbers = sorted(cells)
    radii = [cells[c].radius for c in numbers]
    inners = [list(cells[c].inner) + [math.inf] * (k - len(cells[c].inner)) for c in numbers]
    centres_used = [pivots[c] for c in numbers]

    def to_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.asarray(centres_used)
        radius = np.asarray(radii)
        reach = np.asarray(inners)
        ids = np.asarray(numbers, dtype="int32")
        slack = 1e-9
        step = max(1, CHUNK_CELLS // max(reach.size, len(centres) * centres.shape[1]))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            all_points = _rows(batch.column("point"))
            for start in range(0, len(all_points), step):
                own = all_points[start : start + step]
                away = np.stack(
                    [np.sqrt(((own - centre) ** 2).sum(axis=1)) for centre in centres], axis=1
                )
                upper = (away[:, :, None] + reach[None, :, :]).reshape(len(own), -1)
                place = min(k, upper.shape[1]) - 1
                bound = np.partition(upper, place, axis=1)[:, place]
                allowed = (bound * (1 + slack) + slack)[:, None]
                rows, hits = np.nonzero(away - radius[None, :] <= allowed)
                visitor = batch.column("visitor").take(pa.array(rows + start))
                yield pa.RecordBatch.from_arrays(
                    [visitor, _lists(own[rows]), pa.array(ids[hits])], ["visitor", "point", "cell"]
                )

    candidates = visitors.select("visitor", "point").mapInArrow(
        to_candidates, "visitor long, point array<double>, cell int"
    )
    if total > STORED_ROWS:
        candidates = cut_lineage(candidates)
    loads = {r.cell: r.n for r in candidates.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    grid = spark.createDataFrame(
        [
            (c, math.ceil(cells[c].n / block_rows), math.ceil(loads[c] / block_rows))
            for c in numbers
            if c in loads
        ],
        "cell int, train_blocks int, test_blocks int",
    )
    # one row per pivot
    grid = F.broadcast(grid)
    left = (
        in_cells.join(grid, "cell")
        .withColumn("train_block", F.pmod(F.xxhash64("key"), F.col("train_blocks")).cast("int"))
        .withColumn("test_block", F.explode(F.sequence(F.lit(0), F.col("test_blocks") - 1)))
        .select("cell", "train_block", "test_block", "key", "point")
    )
    right = (
        candidates.join(grid, "cell")
        .withColumn("test_block", F.pmod(F.xxhash64("visitor"), F.col("test_blocks")).cast("int"))
        .withColumn("train_block", F.explode(F.sequence(F.lit(0), F.col("train_blocks") - 1)))
        .select("cell", "train_block", "test_block", "visitor", "point")
    )

    found = pa.schema([("visitor", pa.int64()), ("key", pa.null()), ("distance", pa.float64())])

    def block_top(train_rows: pa.Table, test_rows: pa.Table) -> pa.Table:
        kind = found.set(1, pa.field("key", train_rows.schema.field("key").type))
        if not len(train_rows) or not len(test_rows):
            return kind.empty_table()
        train_rows = train_rows.sort_by("key")
        base = _rows(train_rows["point"])
        base_norm = (base**2).sum(axis=1)
        asked = _rows(test_rows["point"])
        place = min(k, len(base)) - 1
        step = max(1, CHUNK_CELLS // len(base))
        whose, which, how_far = [], [], []
        for start in range(0, len(asked), step):
            own = asked[start : start + step]
            own_norm = (own**2).sum(axis=1)
            rough = own @ base.T
            rough *= -2
            rough += base_norm
            rough += own_norm[:, None]
            cut = np.partition(rough, place, axis=1)[:, place]
            # the expanded square loses digits: keep everything within its error
            error = 1e-9 * (own_norm + base_norm.max() + 1)
            mine, near = np.nonzero(rough <= (cut + error)[:, None])
            exact = np.empty(len(near))
            some = max(1, CHUNK_CELLS // base.shape[1])
            for at in range(0, len(near), some):
                gap = base[near[at : at + some]] - own[mine[at : at + some]]
                exact[at : at + some] = np.sqrt((gap**2).sum(axis=1))
            # by point and distance; equal distances stay in the order of the keys
            order = np.lexsort((exact, mine))
            mine, near, exact = mine[order], near[order], exact[order]
            best = np.arange(len(mine)) - np.searchsorted(mine, mine) < k
            whose.append(mine[best] + start)
            which.append(near[best])
            how_far.append(exact[best])
        visitor = test_rows["visitor"].take(pa.array(np.concatenate(whose)))
        keys = train_rows["key"].take(pa.array(np.concatenate(which)))
        return pa.table([visitor, keys, pa.array(np.concatenate(how_far))], schema=kind)

    names = ["cell", "train_block", "test_block"]
    partial = (
        left.groupBy(*names)
        .cogroup(right.groupBy(*names))
        .applyInArrow(block_top, f"visitor long, key {key_type}, distance double")
    )
    best = Window.partitionBy("visitor").orderBy("distance", "key")
    ranked = partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(visitors, "visitor").select("visitor", "point", "rank", "key", "distance")
