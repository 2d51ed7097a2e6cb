"""Exact order statistics, rank quotas and running sums that never put an
unbounded group into one task.

Each function has two exact paths and picks one by a measured size:

* small input - one built-in aggregate or one window per group;
* anything larger - a few bounded-shuffle passes (histogram refinement), or a
  range-partitioned running sum. Memory per task does not grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mlscout.functions.hashing import HASH_RANGE, content_hash, row_hash
from mlscout.kinds import column, finite_double, present_double
from mlscout.session import cut_lineage

MAX_CELLS = 5_000_000  # values one built-in exact percentile aggregate may hold
MAX_GROUP_ROWS = 1_000_000  # rows one window partition may hold
BINS = 1024
HASH_BITS = 12  # hashes are counted in 2 ** HASH_BITS equal ranges
COPIES_PER_TASK_ROW = 100_000

_GRID = [i / 100 for i in range(101)]
_MIDDLE = [0.49, 0.51]  # around a median, wider than the error of the approximation


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    keep_infinite: bool = False,
    max_cells: int = MAX_CELLS,
    n_rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns, missing values skipped.

    Infinite values are skipped too unless ``keep_infinite``. ``n_rows`` saves the count
    when the caller already knows the number of rows.
    """
    if not columns:
        return {}
    value = present_double if keep_infinite else finite_double
    narrow = df.select(*[value(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    if (narrow.count() if n_rows is None else n_rows) * len(columns) <= max_cells:
        row = narrow.agg(
            *[F.percentile(f"v{i}", list(probs)).alias(f"q{i}") for i in range(len(columns))]
        ).first()
        return {
            c: list(row[i]) if row[i] is not None else [None] * len(probs)
            for i, c in enumerate(columns)
        }
    return _refined_quantiles(narrow, columns, probs)


def _refined_quantiles(
    narrow: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    entries = F.array(
        *[F.struct(F.lit(i).alias("g"), F.col(f"v{i}").alias("v")) for i in range(len(columns))]
    )
    long = narrow.select(F.inline(entries)).filter("v IS NOT NULL")
    infinity = float("inf")
    tails = {
        r.g: r
        for r in long.groupBy("g")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("v") == -infinity).alias("low"),
            F.count_if(F.col("v") == infinity).alias("high"),
        )
        .collect()
    }
    positions = {
        g: [(math.floor((t.n - 1) * p), math.ceil((t.n - 1) * p)) for p in probs]
        for g, t in tails.items()
    }
    wanted = {}
    for g, t in tails.items():
        ranks = {r - t.low for pair in positions[g] for r in pair}
        wanted[g] = sorted(r for r in ranks if 0 <= r < t.n - t.low - t.high)
    found = select_ranks(long.filter(F.abs("v") < infinity), wanted)

    def at(g: int, rank: int) -> float:
        t = tails[g]
        if rank < t.low:
            return -infinity
        if rank >= t.n - t.high:
            return infinity
        return found[g, rank - t.low][0]

    result: dict[str, list[float | None]] = {}
    for g, name in enumerate(columns):
        if g not in tails:
            result[name] = [None] * len(probs)
            continue
        quantiles = []
        for p, (lower, upper) in zip(probs, positions[g]):
            position = (tails[g].n - 1) * p
            low, high = at(g, lower), at(g, upper)
            if low == high:
                quantiles.append(low)
            else:
                quantiles.append((upper - position) * low + (position - lower) * high)
        result[name] = quantiles
    return result


def select_ranks(
    long: DataFrame, wanted: dict[int, list[int]]
) -> dict[tuple[int, int], tuple[float, int, int]]:
    """The values at 0-based ranks of ``v`` within each ``g``.

    Returns ``(g, rank) -> (value, rows below it, rows equal to it)``. Approximate
    percentiles give a first bracket per rank; each pass then counts the rows of
    every bracket in ``BINS`` equal bins and keeps the bin that holds the rank.
    A pass shuffles at most ``BINS`` rows per bracket and map task, and the
    smallest and largest value of a bracket never share a bin, so it ends.
    """
    wanted = {g: ranks for g, ranks in wanted.items() if ranks}
    if not wanted:
        return {}
    spark = long.sparkSession
    overview = {
        r.g: r
        for r in long.filter(F.col("g").isin(list(wanted)))
        .groupBy("g")
        .agg(
            F.count("*").alias("n"),
            F.min("v").alias("low"),
            F.max("v").alias("high"),
            F.percentile_approx("v", _GRID, 10_000).alias("cuts"),
        )
        .collect()
    }
    # target -> [bracket low, bracket high, rank within the bracket, rows below it]
    open_targets: dict[tuple[int, int], list] = {}
    for g, ranks in wanted.items():
        o = overview[g]
        for rank in ranks:
            share = rank / max(o.n - 1, 1)
            first = math.floor((share - 0.002) * 100)
            last = math.ceil((share + 0.002) * 100)
            low = o.cuts[first] if first > 0 else o.low
            high = o.cuts[last] if last < 100 else o.high
            open_targets[g, rank] = [low, high, None, 0]
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    while open_targets:
        hits = _histogram_pass(spark, long, open_targets)
        for target, state in list(open_targets.items()):
            g, rank = target
            hit = hits.get(target)
            if hit is None or hit.bin == 0:
                # the approximate bracket missed the rank: use the full range
                open_targets[target] = [overview[g].low, overview[g].high, None, 0]
                continue
            below = state[3] + hit.below
            if hit.low == hit.high:
                found[target] = (hit.low, below, hit.n)
                del open_targets[target]
            else:
                open_targets[target] = [hit.low, hit.high, rank - below, below]
    return found


def _histogram_pass(spark: SparkSession, long: DataFrame, targets: dict) -> dict:
    rows = [
        (i, g, float(low), float(high), inner is None, int(rank if inner is None else inner))
        for i, ((g, rank), (low, high, inner, _)) in enumerate(targets.items())
    ]
    # one row per open target: (columns or large groups) x (ranks asked for)
    brackets = spark.createDataFrame(
        rows, "t int, bg int, low double, high double, whole boolean, rank bigint"
    )
    inside = F.when(F.col("low") == F.col("high"), F.lit(1)).otherwise(
        F.width_bucket(F.col("v"), F.col("low"), F.col("high"), F.lit(BINS))
    )
    binned = long.join(
        F.broadcast(brackets),
        (F.col("g") == F.col("bg"))
        & (F.col("v") <= F.col("high"))
        & (F.col("whole") | (F.col("v") >= F.col("low"))),
    ).withColumn("bin", F.when(F.col("v") < F.col("low"), F.lit(0)).otherwise(inside))
    bins = binned.groupBy("t", "rank", "bin").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    upto = Window.partitionBy("t").orderBy("bin")  # at most BINS + 2 rows each
    placed = bins.withColumn("below", F.sum("n").over(upto) - F.col("n")).filter(
        (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n"))
    )
    names = list(targets)
    return {names[r.t]: r for r in placed.collect()}


def part_medians(
    rows: DataFrame, columns: Sequence[str], fold: str, parts: Sequence[Any]
) -> dict[tuple[str, Any], float | None]:
    """Exact medians of every column over every part, missing values skipped, infinite ones not.

    A part is None, for all rows, or a value of ``fold``, for the rows of all other folds. Rows are
    counted per fold, so a pass meets a value once, however many parts there are; what a part is
    made of is added up over the counts.
    """
    folds = [p for p in parts if p is not None]
    names = F.array(*[F.lit(f) for f in folds]) if folds else F.array().cast("array<int>")
    entries = F.array(
        *[F.struct(F.lit(i).alias("g"), present_double(rows, c).alias("v")) for i, c in enumerate(columns)]
    )
    number = F.coalesce(F.array_position(names, column(fold)), F.lit(0)).cast("int")
    long = rows.select(number.alias("f"), F.inline(entries)).filter("v IS NOT NULL")
    infinity = float("inf")
    finite = F.when(F.abs("v") < infinity, F.col("v"))
    overview: dict[int, list] = {}
    for r in (
        long.groupBy("g", "f")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("v") == -infinity).alias("below"),
            F.count_if(F.col("v") == infinity).alias("above"),
            F.min(finite).alias("low"),
            F.max(finite).alias("high"),
            F.percentile_approx(finite, _MIDDLE, 10_000).alias("cuts"),
        )
        .collect()
    ):
        overview.setdefault(r.g, []).append(r)
    out: dict[tuple[str, Any], float | None] = {}
    ends: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    # (column, number of the fold left out, rank) -> [low, high, rank within, rows below], as in select_ranks
    targets: dict[tuple[int, int, int], list] = {}
    whole: dict[tuple[int, int], list] = {}
    for g, c in enumerate(columns):
        for part in parts:
            left = -1 if part is None else folds.index(part) + 1
            own = [r for r in overview.get(g, []) if r.f != left]
            n, below = sum(r.n for r in own), sum(r.below for r in own)
            inner = n - below - sum(r.above for r in own)
            if not n:
                out[c, part] = None
                continue
            ends[g, left] = (n, below, inner, (n - 1) // 2)
            some = [r for r in own if r.cuts]
            # the middle of several folds lies between their middles
            whole[g, left] = [min((r.low for r in some), default=None), max((r.high for r in some), default=None)]
            for rank in {(n - 1) // 2 - below, n // 2 - below}:
                if 0 <= rank < inner:
                    near = below <= 0.001 * n and n - below - inner <= 0.001 * n
                    low = min(r.cuts[0] for r in some) if near else whole[g, left][0]
                    high = max(r.cuts[1] for r in some) if near else whole[g, left][1]
                    targets[g, left, rank] = [low, high, None, 0]
    found: dict[tuple[int, int, int], float] = {}
    values = long.filter(F.abs("v") < infinity)
    while targets:
        hits = _part_pass(values, targets)
        for target, state in list(targets.items()):
            hit = hits.get(target)
            if hit is None or hit.bin == 0:
                # the approximate bracket missed the rank: use the full range
                targets[target] = [*whole[target[:2]], None, 0]
            elif hit.low == hit.high:
                found[target] = hit.low
                del targets[target]
            else:
                below = state[3] + hit.below
                targets[target] = [hit.low, hit.high, target[2] - below, below]

    def at(g: int, left: int, rank: int) -> float:
        _, below, inner, _ = ends[g, left]
        if rank < below:
            return -infinity
        return infinity if rank >= below + inner else found[g, left, rank - below]

    for g, c in enumerate(columns):
        for part in parts:
            left = -1 if part is None else folds.index(part) + 1
            if (g, left) in ends:
                n, _, _, lower = ends[g, left]
                low, high = at(g, left, lower), at(g, left, n // 2)
                out[c, part] = low if low == high else 0.5 * low + 0.5 * high
    return out


def _part_pass(values: DataFrame, targets: dict) -> dict:
    """The bin that holds the rank of each target, from counts per bracket, fold and bin."""
    spark = values.sparkSession
    states = {t: (t[0], float(low), float(high), inner is None) for t, (low, high, inner, _) in targets.items()}
    # parts have their middles close together: their ranks mostly share a bracket
    numbers = {state: i for i, state in enumerate(dict.fromkeys(states.values()))}
    # at most two brackets per column and part
    brackets = spark.createDataFrame(
        [(i, *state) for state, i in numbers.items()], "b int, bg int, low double, high double, whole boolean"
    )
    asked = spark.createDataFrame(
        [
            (i, numbers[states[t]], t[1], int(t[2] if inner is None else inner))
            for i, (t, (_, _, inner, _)) in enumerate(targets.items())
        ],
        "t int, b int, away int, rank bigint",
    )
    inside = F.when(F.col("low") == F.col("high"), F.lit(1)).otherwise(
        F.width_bucket(F.col("v"), F.col("low"), F.col("high"), F.lit(BINS))
    )
    binned = values.join(
        F.broadcast(brackets),
        (F.col("g") == F.col("bg"))
        & (F.col("v") <= F.col("high"))
        & (F.col("whole") | (F.col("v") >= F.col("low"))),
    ).withColumn("bin", F.when(F.col("v") < F.col("low"), F.lit(0)).otherwise(inside))
    counts = binned.groupBy("b", "f", "bin").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    bins = (
        counts.join(F.broadcast(asked), "b")
        .filter("f <> away")
        .groupBy("t", "rank", "bin")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    upto = Window.partitionBy("t").orderBy("bin")  # at most BINS + 2 rows each
    placed = bins.withColumn("below", F.sum("n").over(upto) - F.col("n")).filter(
        (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n"))
    )
    names = list(targets)
    return {names[r.t]: r for r in placed.collect()}


def select_hashes(
    rows: DataFrame, wanted: dict[int, int], sizes: dict[int, int] | None = None
) -> dict[int, tuple[int, int, int]]:
    """The ``_hash`` at a 0-based rank within each ``_g``: (hash, rows below it, rows equal to it).

    Hashes spread evenly. Where ``sizes``, the rows of each group, are known, they tell about where
    the rank lies, and one pass counts the rows below and the hashes around it. Where it lies
    elsewhere (many rows with one key), two passes do: rows are counted in ``2 ** HASH_BITS`` equal
    ranges, then the hashes of the range that holds the rank.
    """
    if not wanted:
        return {}
    spark = rows.sparkSession

    def hit(counts: DataFrame, order: str) -> DataFrame:
        upto = Window.partitionBy("_g").orderBy(order)
        placed = counts.withColumn("_below", F.sum("_n").over(upto) - F.col("_n"))
        return placed.filter((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_n")))

    found: dict[int, tuple[int, int, int]] = {}
    if sizes is not None:
        guesses = []
        for g, rank in wanted.items():
            n = sizes[g]
            share = (rank + 0.5) / n
            # ten standard deviations, and some rows more
            reach = (10 * math.sqrt(n * share * (1 - share)) + 10) / n
            low, high = (share - reach) * HASH_RANGE, (share + reach) * HASH_RANGE
            guesses.append((g, rank, int(max(low, 0)), int(min(high, HASH_RANGE))))
        # one row per large group
        near = F.broadcast(spark.createDataFrame(guesses, "_g int, _rank bigint, _low bigint, _high bigint"))
        around = (
            rows.join(near, "_g")
            .filter("_hash <= _high")
            .withColumn("_hash", F.when(F.col("_hash") < F.col("_low"), F.lit(-1)).otherwise(F.col("_hash")))
            .groupBy("_g", "_rank", "_hash")
            .agg(F.count("*").alias("_n"))
        )
        found = {r._g: (r._hash, r._below, r._n) for r in hit(around, "_hash").collect() if r._hash >= 0}
        wanted = {g: rank for g, rank in wanted.items() if g not in found}
        if not wanted:
            return found
    # one row per large group
    ranks = F.broadcast(spark.createDataFrame(list(wanted.items()), "_g int, _rank bigint"))
    binned = rows.withColumn("_bin", hash_bin(HASH_BITS))
    bins = binned.groupBy("_g", "_bin").agg(F.count("*").alias("_n")).join(ranks, "_g")
    held = [(r._g, r._bin, r._rank - r._below, r._below) for r in hit(bins, "_bin").collect()]
    inside = F.broadcast(spark.createDataFrame(held, "_g int, _bin bigint, _rank bigint, _before bigint"))
    hashes = (
        binned.join(inside, ["_g", "_bin"])
        .groupBy("_g", "_rank", "_before", "_hash")
        .agg(F.count("*").alias("_n"))
    )
    return found | {r._g: (r._hash, r._before + r._below, r._n) for r in hit(hashes, "_hash").collect()}


def hash_bin(bits: int) -> Column:
    """The first ``bits`` bits of the column ``_hash``, a :func:`row_hash`."""
    return F.shiftright("_hash", HASH_RANGE.bit_length() - 1 - bits)


def mark_lowest(
    df: DataFrame,
    group: str,
    quotas: DataFrame,
    key: Sequence[str],
    seed: int,
    flag: str,
    *,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add a boolean ``flag`` that is true for exactly ``_k`` rows of each group.

    ``quotas`` has the columns ``group``, ``_n`` (rows of the group) and ``_k``. The
    rows with the lowest key hash are taken. Rows whose group is not in ``quotas``
    (or is NULL) are dropped. Groups up to ``max_group_rows`` are ranked by one
    window; a larger group gets a hash threshold found by :func:`select_hashes`
    and is never shuffled.
    """
    keys = list(key)
    hashed = df.withColumns({"_hash": row_hash(keys, seed), "_content": content_hash(df)})
    quotas = quotas.select(column(group), "_n", "_k")
    large = quotas.filter(F.col("_n") > max_group_rows).collect()
    order = Window.partitionBy(column(group)).orderBy(
        "_hash", *[column(k) for k in keys], "_content"
    )

    def ranked(rows: DataFrame, small_quotas: DataFrame) -> DataFrame:
        return (
            rows.join(small_quotas, group)
            .withColumn(flag, F.row_number().over(order) <= F.col("_k"))
            .select(*[column(c) for c in df.columns], flag)
        )

    if not large:
        return ranked(hashed, quotas)

    spark = df.sparkSession
    group_type = df.schema[group].dataType.simpleString()
    ids = spark.createDataFrame(
        [(r[0], i) for i, r in enumerate(large)], f"_value {group_type}, _g int"
    )
    # at most (all rows / max_group_rows) groups can be large
    tagged = hashed.join(F.broadcast(ids), column(group) == F.col("_value"))
    found = select_hashes(
        tagged.select("_g", "_hash"),
        {i: r._k - 1 for i, r in enumerate(large) if 0 < r._k < r._n},
        {i: r._n for i, r in enumerate(large)},
    )
    bounds = []
    for i, r in enumerate(large):
        if r._k <= 0:
            bounds.append((i, -1.0, 0, False))
        elif r._k >= r._n:
            bounds.append((i, float("inf"), 0, False))
        else:
            value, below, equal = found[i]
            bounds.append((i, float(value), r._k - below, below + equal > r._k))
    limits = spark.createDataFrame(
        bounds, "_g int, _bound double, _tie_quota bigint, _tied boolean"
    )
    tagged = tagged.join(F.broadcast(limits), "_g")
    at_tie = F.col("_tied") & (F.col("_hash") == F.col("_bound"))
    own = [column(c) for c in df.columns]
    clear = tagged.filter(~at_tie).select(*own, (F.col("_hash") <= F.col("_bound")).alias(flag))
    result = clear
    few = quotas.filter(F.col("_n") <= max_group_rows)
    if not few.isEmpty():
        # the hot groups leave before the join: their rows are not shuffled to be dropped
        others = hashed.join(F.broadcast(ids), column(group) == F.col("_value"), "left_anti")
        result = result.unionByName(ranked(others, few))
    if any(tied for *_, tied in bounds):
        ties = tagged.filter(at_tie)
        result = result.unionByName(_split_ties(ties, df.columns, flag))
    return result


def _split_ties(ties: DataFrame, columns: Sequence[str], flag: str) -> DataFrame:
    """Flag ``_tie_quota`` rows among those of each group that share one key hash.

    Copies of a row are collapsed to one row and a count before they are ranked,
    and written out again afterwards, so a heavily repeated row is one row here.
    """
    names = [column(c) for c in columns]
    copies = ties.groupBy("_g", "_tie_quota", *names).agg(F.count("*").alias("_same"))
    content = row_hash(list(columns), 0)
    placed = prefix_sums(copies.withColumn("_content", content), ["_g"], "_content", ["_same"])
    taken = F.greatest(
        F.lit(0), F.least(F.col("_same"), F.col("_tie_quota") - F.col("_same_before"))
    )
    parts = F.array(
        F.struct(F.lit(True).alias(flag), taken.alias("_copies")),
        F.struct(F.lit(False).alias(flag), (F.col("_same") - taken).alias("_copies")),
    )
    pieces = placed.select(*names, F.inline(parts)).filter("_copies > 0")
    biggest = pieces.agg(F.max("_copies")).first()[0] or 0
    return replicate(pieces, F.col("_copies"), biggest).drop("_copies")


def replicate(df: DataFrame, copies: Column, largest: int) -> DataFrame:
    """Repeat every row ``copies`` times; ``largest`` is the biggest count.

    Up to ``COPIES_PER_TASK_ROW`` copies are written in place. Beyond that a row is
    first cut into chunks that are spread over the cluster.
    """
    if largest <= COPIES_PER_TASK_ROW:
        return df.withColumn("_i", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_i")
    per = COPIES_PER_TASK_ROW
    chunks = F.ceil(copies / per).cast("bigint")
    spread = (
        df.withColumn("_total", copies.cast("bigint"))
        .withColumn("_chunk", F.explode(F.sequence(F.lit(1).cast("bigint"), chunks)))
        .repartition("_chunk", "_total")
    )
    size = F.least(F.lit(per).cast("bigint"), F.col("_total") - (F.col("_chunk") - 1) * per)
    return spread.withColumn(
        "_i", F.explode(F.sequence(F.lit(1), size.cast("int")))
    ).drop("_i", "_chunk", "_total")


def prefix_sums(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    sums: Sequence[str],
    *,
    max_group_rows: int = MAX_GROUP_ROWS,
    group_rows: int | None = None,
) -> DataFrame:
    """Add ``<c>_before``: the sum of ``c`` over the rows of the group ordered before.

    ``group_rows``, a known upper bound on the rows of a group, saves the size check.

    ``df`` holds one row per (groups, order) - collapse copies first. Groups that
    fit one window partition use it; otherwise the rows are range-partitioned, the
    totals of the ranges give each range its offset, and windows run per range.
    """
    groups = list(groups)
    # a whole-table sum still needs a partition column, or the window takes one task silently
    keyed = df if groups else df.withColumn("_all", F.lit(0))
    by = groups or ["_all"]
    total, largest = 0, group_rows
    if largest is None or largest > max_group_rows:
        if largest is not None:
            keyed = cut_lineage(keyed)  # likely large: counted, sampled and dealt, but made once
        sizes = keyed.groupBy(*by).count()
        total, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    before = (Window.unboundedPreceding, -1)

    def running(window: Window, name: str) -> Column:
        return F.coalesce(F.sum(column(name)).over(window.rowsBetween(*before)), F.lit(0))

    if (largest or 0) <= max_group_rows:
        window = Window.partitionBy(*by).orderBy(order)
        out = keyed
        for name in sums:
            out = out.withColumn(f"{name}_before", running(window, name))
        return out.drop("_all")

    ranges = max(2, math.ceil(2 * total / max_group_rows))
    stored = cut_lineage(
        keyed.repartitionByRange(ranges, *by, order).withColumn("_range", F.spark_partition_id())
    )
    totals = stored.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    across = Window.partitionBy(*by).orderBy("_range")
    offsets = totals.select(
        *by, "_range", *[running(across, f"_sum_{s}").alias(f"_off_{s}") for s in sums]
    )
    window = Window.partitionBy(*by, "_range").orderBy(order)
    out = stored.join(offsets, [*by, "_range"])
    for name in sums:
        out = out.withColumn(f"{name}_before", running(window, name) + F.col(f"_off_{name}"))
    return out.drop("_range", "_all", *[f"_off_{s}" for s in sums])


def lowest_per_group(
    df: DataFrame, group: str, quotas: DataFrame, key: Sequence[str], seed: int, **options
) -> DataFrame:
    """Exactly ``k`` rows of each group, those with the lowest key hash."""
    flagged = mark_lowest(df, group, quotas, key, seed, "_taken", **options)
    return flagged.filter("_taken").drop("_taken")
