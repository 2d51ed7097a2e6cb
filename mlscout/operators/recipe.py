"""Feature recipes: fitted on training rows only, applied anywhere.

``Step.fit`` reads aggregates and returns plain parameters; ``apply`` turns the
parameters into Column expressions, so a fitted recipe is a chain of projections that
Catalyst fuses into one stage, and it can be stored as JSON.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlscout.functions.counts import top_values, value_counts
from mlscout.functions.ordering import MAX_CELLS, exact_quantiles
from mlscout.kinds import (
    BOOLEAN,
    CATEGORICAL,
    NESTED,
    NUMERIC,
    OTHER,
    TEMPORAL,
    column,
    columns_of,
    missing,
    present_double,
)
from mlscout.operators.gram import pair_correlations

MAX_LEVELS = 1000  # levels of one column that may become parameters
OTHER_LEVEL = "OTHER"
NOVEL_LEVEL = "new"
POOL_SHARE = 0.05
MAX_CORRELATION = 0.9
NZV_FREQUENCY_CUT = 95 / 5
NZV_UNIQUE_CUT = 10


@dataclass
class Levels:
    """Value counts of a text column: all of them, or the ``MAX_LEVELS`` most frequent."""

    counts: dict[str, int]
    n_unique: int
    n_missing: int
    total: int = 0  # non-missing rows

    @property
    def complete(self) -> bool:
        return self.n_unique <= MAX_LEVELS


class Moments(NamedTuple):
    """Of the values that are there; ``sd`` is None for fewer than two."""

    n: int
    mean: float
    sd: float | None
    low: float
    high: float


class Context:
    """What a recipe being fitted already knows about the current training frame."""

    def __init__(self, fixed: Sequence[str], n_rows: int | None = None) -> None:
        self.fixed = list(fixed)
        self.n_rows = n_rows
        self._levels: dict[str, Levels] = {}
        self._moments: dict[str, tuple] = {}
        self.changed: set[str] = set()  # columns that a step of this part has altered

    def numeric(self, df: DataFrame) -> list[str]:
        return columns_of(df, NUMERIC, exclude=self.fixed)

    def nominal(self, df: DataFrame) -> list[str]:
        return columns_of(df, CATEGORICAL, exclude=self.fixed)

    def levels(self, df: DataFrame, columns: Sequence[str]) -> dict[str, Levels]:
        """Level counts; one job covers every column not counted yet."""
        wanted = [c for c in columns if c not in self._levels]
        if wanted:
            self._levels.update(self._count_levels(df, wanted))
        return {c: self._levels[c] for c in columns}

    def _count_levels(self, df: DataFrame, names: Sequence[str]) -> dict[str, Levels]:
        counts = value_counts(df, names)
        sizes = counts.groupBy("column").agg(
            F.count("value").alias("n_unique"),
            F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("total"),
            F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("n_missing"),
        )
        top = top_values(counts, MAX_LEVELS).select("column", "value", "n")
        found = {c: Levels({}, 0, 0) for c in names}
        for r in sizes.join(top, "column", "left").collect():
            entry = found[r["column"]]
            entry.n_unique, entry.n_missing = r.n_unique, r.n_missing or 0
            entry.total = r.total or 0
            if r.value is not None:
                entry.counts[r.value] = r.n
        return found

    def set_levels(self, name: str, counts: dict[str, int], n_unique: int, n_missing: int) -> None:
        total = self._levels[name].total + self._levels[name].n_missing - n_missing
        self._levels[name] = Levels(counts, n_unique, n_missing, total)

    def moments(self, df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
        """(mean, sample sd, min, max) per column; one aggregate for all new columns."""
        wanted = [c for c in columns if c not in self._moments]
        if wanted:
            self._moments.update(self._count_moments(df, wanted))
        return {c: self._moments[c] for c in columns}

    def _count_moments(self, df: DataFrame, names: Sequence[str]) -> dict[str, tuple]:
        parts = []
        for c in names:
            value = present_double(df, c)
            parts += [F.avg(value), F.stddev_samp(value), F.min(value), F.max(value)]
        row = df.agg(*[p.alias(f"a{i}") for i, p in enumerate(parts)]).first()
        return {c: tuple(row[4 * i : 4 * i + 4]) for i, c in enumerate(names)}

    def summaries(
        self, df: DataFrame, names: Sequence[str], exact: bool
    ) -> dict[str, tuple[float | None, Moments | None]]:
        """(median, moments) per column; moments are None where they would cost another pass."""
        if self.n_rows is None:
            self.n_rows = df.count()
        if exact and self.n_rows * len(names) > MAX_CELLS:
            found = exact_quantiles(df, names, [0.5], keep_infinite=True, n_rows=self.n_rows)
            return {c: (q[0], None) for c, q in found.items()}
        # one aggregate: the median, and the moments the filled column will have
        parts = []
        for c in names:
            value = present_double(df, c)
            middle = F.percentile(value, 0.5) if exact else F.percentile_approx(value, 0.5, 10_000)
            parts += [
                middle, F.count(value), F.avg(value), F.stddev_samp(value), F.min(value), F.max(value)
            ]
        row = df.agg(*[p.alias(f"a{i}") for i, p in enumerate(parts)]).first()
        found = {c: row[6 * i : 6 * i + 6] for i, c in enumerate(names)}
        return {c: (v[0], Moments(*v[1:]) if v[1] else None) for c, v in found.items()}

    def correlations(self, df: DataFrame, names: Sequence[str]) -> list[list[float]]:
        return correlation_matrix(df, names)

    def note(self, step: str, params: dict[str, Any]) -> None:
        """A step has been applied; the columns it altered are no longer those of the table."""
        for changes in params.values():
            self.changed |= set(changes) if isinstance(changes, dict) else set()

    def set_moments(self, name: str, moments: tuple) -> None:
        self._moments[name] = moments

    def forget_moments(self, columns: Sequence[str]) -> None:
        for c in columns:
            self._moments.pop(c, None)


class Step:
    """A recipe step; ``columns=None`` means every predictor of the step's kind."""

    name = ""
    training_only = False
    schema_only = False  # the parameters come from the schema alone

    def __init__(self, columns: Sequence[str] | None = None) -> None:
        self.columns = list(columns) if columns is not None else None

    def _chosen(self, available: list[str]) -> list[str]:
        return available if self.columns is None else [c for c in available if c in self.columns]

    def fit(self, df: DataFrame, context: Context) -> dict[str, Any]:
        raise NotImplementedError

    @staticmethod
    def apply(df: DataFrame, params: dict[str, Any]) -> DataFrame:
        raise NotImplementedError


class AsNumber(Step):
    """Booleans to 0/1, dates and times to epoch seconds; nested columns are dropped.

    Columns of kinds no learner can use (intervals, nulls) are dropped as well.
    """

    name = "as_number"
    schema_only = True

    def fit(self, df, context):
        return {
            "boolean": columns_of(df, BOOLEAN, exclude=context.fixed),
            "temporal": columns_of(df, TEMPORAL, exclude=context.fixed),
            "dropped": columns_of(df, NESTED, OTHER, exclude=context.fixed),
        }

    @staticmethod
    def apply(df, params):
        changes = {c: column(c).cast("double") for c in params["boolean"]}
        for c in params["temporal"]:
            changes[c] = F.unix_seconds(column(c).cast("timestamp")).cast("double")
        out = df.drop(*params["dropped"])
        return out.withColumns(changes) if changes else out


def _filled_moments(
    n: int, mean: float, sd: float, low: float, high: float, filled: int, median: float
) -> tuple[float, float, float, float]:
    """(mean, sd, min, max) of n values after ``filled`` copies of their median are added."""
    total = n + filled
    new_mean = (n * mean + filled * median) / total
    squares = sd**2 * (n - 1) + n * (mean - new_mean) ** 2 + filled * (median - new_mean) ** 2
    return new_mean, (squares / (total - 1)) ** 0.5 if total > 1 else 0.0, low, high


class ImputeMedian(Step):
    """Training median into missing numeric values; the columns become double."""

    name = "impute_median"

    def __init__(self, columns: Sequence[str] | None = None, exact: bool = True) -> None:
        super().__init__(columns)
        self.exact = exact

    def fit(self, df, context):
        names = self._chosen(context.numeric(df))
        if not names:
            return {"medians": {}}
        medians = {}
        for c, (median, m) in context.summaries(df, names, self.exact).items():
            medians[c] = median
            if median is None:
                context.set_moments(c, (None,) * 4)  # no value anywhere
            elif m is None:
                context.forget_moments([c])
            else:
                filled = context.n_rows - m.n
                context.set_moments(c, _filled_moments(m.n, m.mean, m.sd or 0.0, m.low, m.high, filled, median))
        return {"medians": medians}

    @staticmethod
    def apply(df, params):
        changes = {}
        for c, median in params["medians"].items():
            changes[c] = F.coalesce(present_double(df, c), F.lit(median).cast("double"))
        return df.withColumns(changes) if changes else df


class ImputeMode(Step):
    """Most frequent training value into missing text values."""

    name = "impute_mode"

    def fit(self, df, context):
        modes = {}
        for c, found in context.levels(df, self._chosen(context.nominal(df))).items():
            if not found.counts:
                continue
            mode = min(found.counts, key=lambda v: (-found.counts[v], v))
            modes[c] = mode
            counts = dict(found.counts)
            counts[mode] += found.n_missing
            context.set_levels(c, counts, found.n_unique, 0)
        return {"modes": modes}

    @staticmethod
    def apply(df, params):
        changes = {c: F.coalesce(column(c), F.lit(m)) for c, m in params["modes"].items()}
        return df.withColumns(changes) if changes else df


class NovelLevel(Step):
    """Values not seen in training become the level ``new``.

    A column with more than ``MAX_LEVELS`` levels is left alone here: pooling, which
    must follow before it can be coded, treats its unseen values the same way.
    """

    name = "novel_level"

    def fit(self, df, context):
        found = context.levels(df, self._chosen(context.nominal(df)))
        return {"levels": {c: sorted(v.counts) for c, v in found.items() if v.complete}}

    @staticmethod
    def apply(df, params):
        changes = {}
        for c, levels in params["levels"].items():
            known = column(c).isNull() | column(c).isin(levels)
            changes[c] = F.when(known, column(c)).otherwise(F.lit(NOVEL_LEVEL))
        return df.withColumns(changes) if changes else df


class PoolRare(Step):
    """Levels below a share of the training rows, and unseen ones, become ``OTHER``.

    A column with no rare level is left alone.
    """

    name = "pool_rare"

    def __init__(
        self,
        columns: Sequence[str] | None = None,
        threshold: float = POOL_SHARE,
        other: str = OTHER_LEVEL,
    ) -> None:
        super().__init__(columns)
        if threshold < 1 / MAX_LEVELS:
            raise ValueError(f"the threshold must be at least {1 / MAX_LEVELS}")
        self.threshold = threshold
        self.other = other

    def fit(self, df, context):
        kept = {}
        for c, found in context.levels(df, self._chosen(context.nominal(df))).items():
            if not found.counts:
                continue
            keep = [v for v, n in found.counts.items() if n / found.total >= self.threshold]
            if not keep:
                keep = [min(found.counts, key=lambda v: (-found.counts[v], v))]
            if len(keep) == found.n_unique:
                continue
            kept[c] = sorted(keep)
            counts = {v: found.counts[v] for v in kept[c]}
            pooled = found.total - sum(counts.values())
            counts[self.other] = counts.get(self.other, 0) + pooled
            context.set_levels(c, counts, len(counts), found.n_missing)
        return {"keep": kept, "other": self.other}

    @staticmethod
    def apply(df, params):
        changes = {}
        for c, keep in params["keep"].items():
            stays = column(c).isNull() | column(c).isin(keep)
            changes[c] = F.when(stays, column(c)).otherwise(F.lit(params["other"]))
        return df.withColumns(changes) if changes else df


class DropUnusedLevels(Step):
    """Nothing to do here: levels are always those found in the training rows."""

    name = "drop_unused_levels"

    def fit(self, df, context):
        return {}

    @staticmethod
    def apply(df, params):
        return df


def _coded_levels(step: Step, df: DataFrame, context: Context) -> dict[str, list[str]]:
    found = context.levels(df, step._chosen(context.nominal(df)))
    wide = [c for c, v in found.items() if not v.complete]
    if wide:
        raise ValueError(
            f"columns with more than {MAX_LEVELS} levels must be pooled or dropped "
            f"before they are coded: {', '.join(wide)}"
        )
    return {c: sorted(v.counts) for c, v in found.items()}


def dummy_name(name: str, level: str) -> str:
    return f"{name}_{level}"


class Dummy(Step):
    """One 0/1 column per level; the alphabetically first level is the reference.

    A value without a column of its own (reference, unseen) is all zeros.
    """

    name = "dummy"

    def __init__(self, columns: Sequence[str] | None = None, one_hot: bool = False) -> None:
        super().__init__(columns)
        self.one_hot = one_hot

    def fit(self, df, context):
        levels = _coded_levels(self, df, context)
        first = 0 if self.one_hot else 1
        for c, found in context.levels(df, list(levels)).items():
            rows = found.total + found.n_missing
            for v in levels[c][first:]:
                # a 0/1 column needs no pass of its own
                share = found.counts[v] / rows
                sd = (share * (1 - share) * rows / (rows - 1)) ** 0.5 if rows > 1 else 0.0
                context.set_moments(
                    dummy_name(c, v), (share, sd, float(share == 1.0), float(share > 0.0))
                )
        return {"levels": levels, "first": first}

    @staticmethod
    def apply(df, params):
        coded = params["levels"]
        out = [column(c) for c in df.columns if c not in coded]
        for c, levels in coded.items():
            out += [
                F.when(column(c) == v, F.lit(1.0)).otherwise(F.lit(0.0)).alias(dummy_name(c, v))
                for v in levels[params["first"] :]
            ]
        return df.select(*out)


class IntegerEncode(Step):
    """1-based position of the level in alphabetical order; unseen values are 0."""

    name = "integer_encode"

    def fit(self, df, context):
        return {"levels": _coded_levels(self, df, context)}

    @staticmethod
    def apply(df, params):
        changes = {}
        for c, levels in params["levels"].items():
            known = F.array(*[F.lit(v) for v in levels]).cast("array<string>")
            changes[c] = F.array_position(known, column(c)).cast("int")
        return df.withColumns(changes) if changes else df


class DropColumns(Step):
    name = "drop_columns"
    schema_only = True

    def __init__(self, columns: Sequence[str]) -> None:
        super().__init__(columns)

    def fit(self, df, context):
        return {"columns": [c for c in self.columns if c in df.columns and c not in context.fixed]}

    @staticmethod
    def apply(df, params):
        return df.drop(*params["columns"])


class DropZeroVariance(DropColumns):
    """Drop predictors with at most one distinct non-missing training value."""

    name = "drop_zero_variance"
    schema_only = False

    def __init__(self, columns: Sequence[str] | None = None) -> None:
        Step.__init__(self, columns)

    def fit(self, df, context):
        moments = context.moments(df, self._chosen(context.numeric(df)))
        flat = [c for c, (_, _, low, high) in moments.items() if low is None or low == high]
        levels = context.levels(df, self._chosen(context.nominal(df)))
        flat += [c for c, found in levels.items() if found.n_unique <= 1]
        return {"columns": flat}


class DropMissingColumns(DropColumns):
    """Drop predictors whose training missing share is above the threshold."""

    name = "drop_missing_columns"
    schema_only = False

    def __init__(self, columns: Sequence[str] | None = None, threshold: float = 0.5) -> None:
        Step.__init__(self, columns)
        self.threshold = threshold

    def fit(self, df, context):
        names = self._chosen([c for c in df.columns if c not in context.fixed])
        row = df.agg(F.count("*"), *[F.count_if(missing(df, c)) for c in names]).first()
        share = {c: n / row[0] for c, n in zip(names, row[1:])} if row[0] else {}
        return {"columns": [c for c in names if share.get(c, 0) > self.threshold]}


class DropNearZeroVariance(DropColumns):
    """Drop predictors dominated by one value and with few distinct values."""

    name = "drop_near_zero_variance"
    schema_only = False

    def __init__(
        self,
        columns: Sequence[str] | None = None,
        freq_cut: float = NZV_FREQUENCY_CUT,
        unique_cut: float = NZV_UNIQUE_CUT,
    ) -> None:
        Step.__init__(self, columns)
        self.freq_cut = freq_cut
        self.unique_cut = unique_cut

    def fit(self, df, context):
        names = self._chosen([c for c in df.columns if c not in context.fixed])
        if not names:
            return {"columns": []}
        counts = value_counts(df, names).filter("value IS NOT NULL")
        sizes = counts.groupBy("column").agg(
            F.count("*").alias("n_unique"), F.sum("n").alias("total")
        )
        # at most two rows per column reach the driver
        top = top_values(counts, 2).groupBy("column").agg(
            F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("first"),
            F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("second"),
        )
        stats = {r["column"]: r for r in sizes.join(top, "column").collect()}
        flat = []
        for c in names:
            s = stats.get(c)
            if s is None or s.n_unique == 1:
                flat.append(c)
            elif s.first / s.second > self.freq_cut:
                if 100 * s.n_unique / s.total <= self.unique_cut:
                    flat.append(c)
        return {"columns": flat}


class DropCorrelated(DropColumns):
    """Drop numeric predictors until no pair has |r| above the threshold."""

    name = "drop_correlated"
    schema_only = False

    def __init__(
        self, columns: Sequence[str] | None = None, threshold: float = MAX_CORRELATION
    ) -> None:
        Step.__init__(self, columns)
        self.threshold = threshold

    def fit(self, df, context):
        names = self._chosen(context.numeric(df))
        if len(names) < 2:
            return {"columns": []}
        return {"columns": correlated_columns(names, context.correlations(df, names), self.threshold)}


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """Pearson matrix, each pair over the rows where both are finite; p x p numbers reach the driver.

    A pair with a constant side, or never present together, has NaN.
    """
    values = df.select(*[present_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    matrix = [[1.0 if i == j else math.nan for j in range(len(columns))] for i in range(len(columns))]
    for row in pair_correlations(values, values.columns).collect():
        i, j = int(row["column_a"][1:]), int(row["column_b"][1:])
        matrix[i][j] = matrix[j][i] = math.nan if row["r"] is None else row["r"]
    return matrix


def correlated_columns(
    names: Sequence[str], matrix: Sequence[Sequence[float]], threshold: float
) -> list[str]:
    """Take the strongest remaining pair, drop its member with the larger mean |r|, repeat."""
    size = [[0.0 if r != r else abs(r) for r in row] for row in matrix]
    left = list(range(len(names)))
    dropped = []
    pairs = [
        (size[i][j], i, j) for i in left for j in left if i < j and size[i][j] > threshold
    ]
    for _, i, j in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if i not in left or j not in left:
            continue
        mean_i = sum(size[i][k] for k in left if k != i)
        mean_j = sum(size[j][k] for k in left if k != j)
        lost = i if mean_i > mean_j else j
        left.remove(lost)
        dropped.append(names[lost])
    return dropped


class Standardize(Step):
    """Training mean 0 and sample sd 1; a constant column becomes 0."""

    name = "standardize"

    def fit(self, df, context):
        names = self._chosen(context.numeric(df))
        moments = context.moments(df, names)
        context.forget_moments(names)
        return {"moments": {c: [m, sd or 1.0] for c, (m, sd, _, _) in moments.items() if m is not None}}

    @staticmethod
    def apply(df, params):
        changes = {}
        for c, (mean, sd) in params["moments"].items():
            changes[c] = (column(c).cast("double") - F.lit(mean)) / F.lit(sd)
        return df.withColumns(changes) if changes else df


class MinMax(Step):
    """Training range to [0, 1]; a constant column becomes 0."""

    name = "min_max"

    def fit(self, df, context):
        names = self._chosen(context.numeric(df))
        moments = context.moments(df, names)
        context.forget_moments(names)
        return {"ranges": {c: [lo, hi] for c, (_, _, lo, hi) in moments.items() if lo is not None}}

    @staticmethod
    def apply(df, params):
        changes = {}
        for c, (low, high) in params["ranges"].items():
            value = column(c).cast("double")
            if low == high:
                changes[c] = F.when(value.isNotNull(), F.lit(0.0))
            else:
                changes[c] = (value - F.lit(low)) / F.lit(high - low)
        return df.withColumns(changes) if changes else df


class OmitMissing(Step):
    """Drop incomplete training rows; rows to be scored are kept."""

    name = "omit_missing"
    training_only = True

    def fit(self, df, context):
        return {}

    @staticmethod
    def apply(df, params):
        return df.dropna("any")


_STEPS = {
    s.name: s
    for s in (
        AsNumber, ImputeMedian, ImputeMode, NovelLevel, PoolRare, DropUnusedLevels, Dummy,
        IntegerEncode, DropColumns, DropZeroVariance, DropMissingColumns, DropNearZeroVariance,
        DropCorrelated, Standardize, MinMax, OmitMissing,
    )
}


@dataclass
class FittedRecipe:
    """Step names with their parameters; ``apply`` only adds projections."""

    target: str
    ids: list[str]
    steps: list[tuple[str, dict[str, Any]]] = field(default_factory=list)
    features: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame, training: bool = False) -> DataFrame:
        out = df
        for name, params in self.steps:
            step = _STEPS[name]
            if training or not step.training_only:
                out = step.apply(out, params)
        return out

    def to_json(self) -> str:
        return json.dumps(
            {"target": self.target, "ids": self.ids, "steps": self.steps, "features": self.features}
        )

    @staticmethod
    def from_json(text: str) -> FittedRecipe:
        parts = json.loads(text)
        steps = [(name, params) for name, params in parts["steps"]]
        return FittedRecipe(parts["target"], parts["ids"], steps, parts["features"])


@dataclass
class Recipe:
    """Ordered steps. ``ids`` (keys, folds) and the target are never touched."""

    target: str
    steps: list[Step]
    ids: list[str] = field(default_factory=list)

    def fit(
        self, train: DataFrame, n_rows: int | None = None, context: Context | None = None
    ) -> FittedRecipe:
        """``n_rows`` saves a count when the caller knows the number of training rows."""
        fixed = [self.target, *self.ids]
        context = context or Context(fixed, n_rows)
        current = train
        fitted = FittedRecipe(self.target, list(self.ids))
        for step in self.steps:
            params = step.fit(current, context)
            current = step.apply(current, params)
            context.note(step.name, params)
            if step.training_only:  # rows are gone: what was counted no longer holds
                context = Context(fixed)
            fitted.steps.append((step.name, params))
        fitted.features = [c for c in current.columns if c not in fixed]
        return fitted


def default_recipe(target: str, ids: Sequence[str] = ()) -> Recipe:
    """The recipe training uses unless another is given."""
    steps = [
        AsNumber(),
        ImputeMedian(),
        ImputeMode(),
        NovelLevel(),
        PoolRare(),
        DropUnusedLevels(),
        Dummy(),
        DropZeroVariance(),
        Standardize(),
        DropCorrelated(),
    ]
    return Recipe(target, steps, list(ids))


def prep_recipe(target: str, issues: DataFrame, ids: Sequence[str] = ()) -> Recipe:
    """The recipe suggested by a table of issues (one row per flagged column)."""
    flagged = issues.filter(F.col("issue_type") == "high_missing").select("column").collect()
    steps: list[Step] = [AsNumber()]
    if flagged:
        steps.append(DropColumns([r["column"] for r in flagged]))
    steps += [ImputeMedian(), ImputeMode(), NovelLevel(), Dummy(), Standardize(), DropNearZeroVariance()]
    return Recipe(target, steps, list(ids))


def recipe_from_options(
    target: str,
    missing: str = "impute",
    encoding: str = "dummy",
    scaling: str = "normalize",
    ids: Sequence[str] = (),
) -> Recipe:
    """A recipe from three choices: missing values, encoding, scaling."""
    handle: dict[str, list[Step]] = {
        "impute": [ImputeMedian(), ImputeMode()],
        "remove_rows": [OmitMissing()],
        "remove_cols": [DropMissingColumns(threshold=0.5)],
        "keep": [],
    }
    encode: dict[str, list[Step]] = {
        "dummy": [Dummy()],
        "label": [IntegerEncode()],
        "keep_cat": [],
    }
    scale: dict[str, list[Step]] = {"normalize": [Standardize()], "minmax": [MinMax()], "none": []}
    for choice, known in ((missing, handle), (encoding, encode), (scaling, scale)):
        if choice not in known:
            raise ValueError(f"unknown option '{choice}'; use one of {', '.join(known)}")
    steps = [AsNumber(), *handle[missing], *encode[encoding], DropZeroVariance(), *scale[scaling]]
    return Recipe(target, steps, list(ids))
