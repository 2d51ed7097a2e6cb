"""One recipe fitted on the training part of every fold, from statistics shared by all folds.

A fold's training part is all rows but its own, so whatever merges is counted once per fold
and put together for each part: level counts as total minus fold, moments by merging the
other folds, and medians of all parts as derived columns of one set of exact quantiles.

Imputed numbers and dummies are sums of few things that no part has a say in: the value, the
gap, each level. So one matrix of products of these per fold, from one scan, gives the
correlations of the transformed columns of every part. The number of scans that the default
recipe takes does not depend on the number of folds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlscout.functions.counts import top_values, value_counts
from mlscout.functions.ordering import MAX_CELLS, exact_quantiles, part_medians
from mlscout.kinds import column, present_double
from mlscout.operators.gram import fold_second_moments
from mlscout.operators.recipe import (
    MAX_LEVELS,
    Context,
    FittedRecipe,
    Levels,
    Moments,
    Recipe,
    dummy_name,
)


def _merged(parts: Sequence[tuple]) -> Moments | None:
    """(n, mean, sd, min, max) of several groups of rows, each (n, mean, squares, min, max)."""
    total, mean, squares, low, high = 0, 0.0, 0.0, None, None
    for n, m, s, lo, hi in parts:
        if not n:
            continue
        gap = m - mean
        squares += s + gap * gap * total * n / (total + n)
        mean += gap * n / (total + n)
        total += n
        low, high = lo if low is None else min(low, lo), hi if high is None else max(high, hi)
    if not total:
        return None
    return Moments(total, mean, (squares / (total - 1)) ** 0.5 if total > 1 else None, low, high)


class FoldStatistics:
    """Statistics of the columns of ``rows`` for every training part, each taken in one job.

    ``parts`` maps a part to its number of rows: a fold, for the rows of all other folds, or
    None for all rows.
    """

    def __init__(self, rows: DataFrame, fold: str, parts: dict[Any, int]) -> None:
        self.rows, self.fold, self.parts = rows, fold, parts
        self.folds = [p for p in parts if p is not None]
        self._levels: dict[str, dict[Any, Levels]] = {}
        self._medians: dict[str, dict[Any, float | None]] = {}
        self._moments: dict[str, dict[Any, Moments | None]] = {}
        self._basis: dict[tuple, int] | None = None

    def levels(self, names: Sequence[str], part: Any) -> dict[str, Levels]:
        new = [c for c in names if c not in self._levels]
        if new:
            self._count_levels(new)
        found = {c: self._levels[c][part] for c in names}
        return {c: Levels(dict(v.counts), v.n_unique, v.n_missing, v.total) for c, v in found.items()}

    def _count_levels(self, names: Sequence[str]) -> None:
        counts = value_counts(self.rows, names, by=[self.fold]).groupBy("position", "column", "value").agg(
            F.sum("n").alias("total"),
            *[
                F.sum(F.when(column(self.fold) == F.lit(f), F.col("n")).otherwise(0)).alias(f"f{i}")
                for i, f in enumerate(self.folds)
            ],
        )
        parts, sides = list(self.parts), []
        for i, part in enumerate(parts):
            own = F.lit(0) if part is None else F.col(f"f{self.folds.index(part)}")
            sides.append(F.struct(F.lit(i).alias("part"), (F.col("total") - own).alias("n")))
        each = counts.select("position", "column", "value", F.inline(F.array(*sides))).filter("n > 0")
        each = each.withColumn("position", F.col("position") * len(parts) + F.col("part"))
        sizes = each.groupBy("position").agg(
            F.first("column").alias("column"),
            F.first("part").alias("part"),
            F.count("value").alias("n_unique"),
            F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("total"),
            F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("n_missing"),
        )
        top = top_values(each, MAX_LEVELS).select("position", "value", "n")
        for c in names:
            self._levels[c] = {p: Levels({}, 0, 0) for p in parts}
        # at most MAX_LEVELS rows per column and part reach the driver
        for r in sizes.join(top, "position", "left").collect():
            entry = self._levels[r["column"]][parts[r["part"]]]
            entry.n_unique, entry.n_missing, entry.total = r.n_unique, r.n_missing or 0, r.total or 0
            if r.value is not None:
                entry.counts[r.value] = r.n

    def moments(self, names: Sequence[str], part: Any) -> dict[str, Moments | None]:
        new = [c for c in names if c not in self._moments]
        if new:
            parts = []
            for c in new:
                value = present_double(self.rows, c)
                parts += [F.count(value), F.avg(value), F.var_pop(value) * F.count(value), F.min(value), F.max(value)]
            named = [p.alias(f"a{i}") for i, p in enumerate(parts)]
            found = {r[0]: tuple(r)[1:] for r in self.rows.groupBy(column(self.fold)).agg(*named).collect()}
            for i, c in enumerate(new):
                per = {f: values[5 * i : 5 * i + 5] for f, values in found.items()}
                self._moments[c] = {
                    part: _merged([v for f, v in sorted(per.items()) if f != part]) for part in self.parts
                }
        return {c: self._moments[c][part] for c in names}

    def medians(self, names: Sequence[str], part: Any) -> dict[str, float | None]:
        new = [c for c in names if c not in self._medians]
        if new:
            n_rows = self.parts[None] if None in self.parts else self.rows.count()
            if n_rows * len(new) * len(self.parts) > MAX_CELLS:
                for (c, p), value in part_medians(self.rows, new, self.fold, list(self.parts)).items():
                    self._medians.setdefault(c, {})[p] = value
            else:
                # few rows: a column per column and part, and one aggregate
                derived = {}
                for c in new:
                    value = present_double(self.rows, c)
                    for i, p in enumerate(self.parts):
                        there = F.lit(True) if p is None else column(self.fold) != F.lit(p)
                        derived[c, p] = F.when(there, value).alias(f"m{len(derived)}_{i}")
                wide = self.rows.select(*derived.values())
                found = exact_quantiles(wide, wide.columns, [0.5], keep_infinite=True, n_rows=n_rows)
                for (c, p), name in zip(derived, wide.columns):
                    self._medians.setdefault(c, {})[p] = found[name][0]
        return {c: self._medians[c][part] for c in names}


    def products(self, wanted: set[tuple]) -> None:
        """Sums of products of the basis columns named, per fold: see ``fold_second_moments``."""
        numbers = sorted({k[1] for k in wanted if k[0] in ("value", "gap")})
        marks = sorted({k for k in wanted if k[0] in ("level", "none")})
        whole = next(iter(self.parts))
        moments = self.moments(numbers, whole)
        shifts = [moments[c].mean if moments[c] else 0.0 for c in numbers]
        scales = [(moments[c] and moments[c].sd) or 1.0 for c in numbers]
        picked = [F.array_position(F.array(*map(F.lit, self.folds)), column(self.fold)).alias("f")]
        picked += [present_double(self.rows, c).alias(f"v{i}") for i, c in enumerate(numbers)]
        for i, key in enumerate(marks):
            text = column(key[1]).cast("string")
            there = text.isNull() if key[0] == "none" else F.coalesce(text == F.lit(key[2]), F.lit(False))
            picked.append(there.cast("double").alias(f"w{i}"))
        found = fold_second_moments(self.rows.select(*picked), shifts, scales)
        self._sums = {f: found[i] for i, f in enumerate(self.folds, 1) if i in found}
        self._scaled = dict(zip(numbers, zip(shifts, scales)))
        basis = [("one",), *[("value", c) for c in numbers], *[("gap", c) for c in numbers], *marks]
        self._basis = {key: i for i, key in enumerate(basis)}

    def correlations(self, forms: Sequence[dict[tuple, float]], part: Any) -> list[list[float]] | None:
        """r of columns that are sums of basis columns, over a training part."""
        if self._basis is None or not all(k in self._basis for form in forms for k in form):
            return None
        sums = sum(m for f, m in self._sums.items() if f != part)
        weights = np.zeros((len(self._basis), len(forms)))
        for j, form in enumerate(forms):
            for key, weight in form.items():
                if key[0] == "gap":  # r does not change when a column is shifted and scaled
                    shift, scale = self._scaled[key[1]]
                    weight = (weight - shift) / scale
                weights[self._basis[key], j] += weight
        products = weights.T @ sums @ weights
        total, n = weights.T @ sums[0], sums[0, 0]
        moments = products - np.outer(total, total) / n
        size = np.where(np.diag(moments) > 1e-12 * np.diag(products), np.diag(moments), 0.0)
        both = np.sqrt(np.outer(size, size))
        r = np.full(products.shape, np.nan)
        np.divide(moments, both, out=r, where=both > 0)
        np.fill_diagonal(r, 1.0)
        return np.clip(r, -1.0, 1.0).tolist()


class PartContext(Context):
    """The context of one training part; columns as the table has them are asked of all folds."""

    def __init__(self, fixed: Sequence[str], part: Any, shared: FoldStatistics) -> None:
        super().__init__(fixed, shared.parts[part])
        self.part, self.shared = part, shared
        self.forms: dict[str, dict[tuple, float]] = {}  # columns as sums of basis columns
        self.modes: dict[str, str] = {}
        self.pooled: dict[str, tuple[list[str], str]] = {}

    def note(self, step, params):
        if step == "impute_median":
            raw = [c for c in params["medians"] if c in self.shared.rows.columns and c not in self.changed]
            moments = self.shared.moments(raw, self.part)
            for c, median in params["medians"].items():
                m = moments.get(c)
                if m and math.isfinite(m.low) and math.isfinite(m.high):
                    self.forms[c] = {("value", c): 1.0, ("gap", c): median}
        elif step == "impute_mode":
            self.modes |= params["modes"]
        elif step == "pool_rare":
            self.pooled |= {c: (keep, params["other"]) for c, keep in params["keep"].items()}
        elif step == "dummy":
            for c, levels in params["levels"].items():
                if c in self.shared.rows.columns:
                    for v in levels[params["first"] :]:
                        self.forms[dummy_name(c, v)] = self._indicator(c, levels, v)
        elif step not in ("novel_level", "standardize", "min_max"):
            # a novel level is none of a training part, and r knows neither shift nor scale
            for changes in params.values():
                for c in changes if isinstance(changes, dict) else ():
                    self.forms.pop(c, None)
        super().note(step, params)

    def _indicator(self, c: str, levels: Sequence[str], value: str) -> dict[tuple, float]:
        """The 0/1 column of a level, in terms of the levels and gaps that the table has."""
        keep, other = self.pooled.get(c, (levels, None))

        def final(raw: str | None) -> str | None:
            raw = self.modes.get(c) if raw is None else raw
            return raw if raw is None or other is None or raw in keep else other

        form = {("level", c, raw): 1.0 for raw in keep if final(raw) == value}
        if value == other:  # all that is neither kept nor missing
            form = {("one",): 1.0, ("none", c): -1.0}
            form |= {("level", c, raw): -1.0 for raw in keep if raw != value}
        if final(None) == value:
            form["none", c] = form.get(("none", c), 0.0) + 1.0
        return form

    def correlations(self, df, names):
        forms = [self.forms.get(c) for c in names]
        found = None if None in forms else self.shared.correlations(forms, self.part)
        return super().correlations(df, names) if found is None else found

    def _common(self, df: DataFrame, names: Sequence[str]) -> bool:
        known = self.shared.rows.columns
        return all(c in known and c not in self.changed for c in names)

    def _count_levels(self, df, names):
        if not self._common(df, names):
            return super()._count_levels(df, names)
        return self.shared.levels(names, self.part)

    def summaries(self, df, names, exact):
        if not exact or not self._common(df, names):
            return super().summaries(df, names, exact)
        moments = self.shared.moments(names, self.part)
        return {c: (m, moments[c]) for c, m in self.shared.medians(names, self.part).items()}

    def _count_moments(self, df, names):
        if not self._common(df, names):
            return super()._count_moments(df, names)
        found = self.shared.moments(names, self.part)
        return {c: (m.mean, m.sd, m.low, m.high) if m else (None,) * 4 for c, m in found.items()}


def fit_parts(recipe: Recipe, rows: DataFrame, fold: str, parts: dict[Any, int]) -> dict[Any, FittedRecipe]:
    """The recipe fitted on every training part of ``rows``; ``parts`` as in ``FoldStatistics``.

    Steps that change rows or columns alike in every part, like conversions, come first and are
    applied once. From the first step that drops rows, each part is fitted on its own.
    """
    fixed = [recipe.target, *recipe.ids]
    steps = list(recipe.steps)
    first = []
    while steps and steps[0].schema_only:  # parameters from the schema are those of every part
        params = steps[0].fit(rows, Context(fixed, parts.get(None)))
        rows = steps[0].apply(rows, params)
        first.append((steps.pop(0).name, params))
    shared = FoldStatistics(rows, fold, parts)
    # the steps before correlations first, for all parts: they tell what the products must cover
    border = next((i for i, s in enumerate(steps) if s.name == "drop_correlated"), len(steps))
    border = border if not any(s.training_only for s in steps[:border]) else len(steps)
    found, contexts, frames = {}, {}, {}
    for part in parts:
        frames[part] = rows if part is None else rows.filter(column(fold) != F.lit(part))
        contexts[part] = PartContext(fixed, part, shared)
        head = Recipe(recipe.target, steps[:border], recipe.ids)
        found[part] = head.fit(frames[part], context=contexts[part])
        frames[part] = found[part].apply(frames[part], training=True)
    if border < len(steps):
        forms = [f for c in contexts.values() for f in c.forms.values()]
        if len(forms) > 1:
            shared.products({key for form in forms for key in form})
        tail = Recipe(recipe.target, steps[border:], recipe.ids)
        for part in parts:
            rest = tail.fit(frames[part], context=contexts[part])
            found[part].steps += rest.steps
            found[part].features = rest.features
    for fitted in found.values():
        fitted.steps = [*first, *fitted.steps]
    return found
