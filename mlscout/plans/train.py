"""Split, fit the recipe, tune, train, predict and evaluate; compare several engines."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.errors import AnalysisException, IllegalArgumentException, SparkRuntimeException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlscout.functions.hashing import content_hash, key_columns, row_hash
from mlscout.kinds import CATEGORICAL, column, columns_of, drop_nested, missing, present_double
from mlscout.operators.clean import oversample, undersample
from mlscout.operators.folds import fit_parts
from mlscout.operators.metrics import metric_set
from mlscout.operators.recipe import FittedRecipe, IntegerEncode, Recipe, default_recipe
from mlscout.operators.split import Split, assign_folds, split
from mlscout.operators.task import CLASSIFICATION, REGRESSION
from mlscout.plans.estimators import (
    DEFAULTS,
    TREE_ENGINES,
    PrunedTree,
    check_engine,
    class_probability,
    has_tunables,
    make_estimator,
    tuning_grid,
)
from mlscout.plans.grown import GrownTrees
from mlscout.plans.knn import NeighbourVoteModel
from mlscout.plans.pruning import PrunedLeaves

FOLDS = 5
TRAIN_GRID = 10
COMPARE_GRID = 5
COMPARE_ENGINES = ["glmnet", "ranger", "xgboost"]
MAX_CLASSES = 1000
PARALLEL_FITS = 4
ROWS_PER_TASK = 25_000
PARALLEL_FOLD_ROWS = 50_000_000
PERMUTATION_BUCKET_ROWS = 100_000
METRIC_SCHEMA = "metric string, estimator string, estimate double"
CV_SCHEMA = "config string, metric string, mean double, std_err double, n int"

#: what a learner or its data can be at fault for; a lost executor is none of these
ESTIMATOR_ERRORS = (
    ValueError, ArithmeticError, IllegalArgumentException, AnalysisException, SparkRuntimeException
)

STORAGE = StorageLevel.MEMORY_AND_DISK


@dataclass
class FittedModel:
    """A fitted recipe and learner; scores any table with the training columns."""

    recipe: FittedRecipe
    learner: Any
    engine: str
    task_type: str
    target: str
    levels: list[Any]
    params: dict[str, Any]

    def score(self, features: DataFrame) -> DataFrame:
        """The packed columns plus ``prediction`` and, for classes, ``probability``."""
        scored = self.learner.transform(features)
        own = ["_kept.*"] if "_kept" in features.columns else []
        if self.task_type == REGRESSION:
            return scored.select(*own, F.col("prediction").cast("double").alias("prediction"))
        known = F.array(*[F.lit(v) for v in self.levels])
        label = F.get(known, F.col("prediction").cast("int")).alias("prediction")
        chances = class_probability(scored, self.engine, len(self.levels)).alias("probability")
        return scored.select(*own, label, chances)

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Predictions for raw rows, next to the ``keep`` columns as they came."""
        return self.score(_assemble(self.recipe, _pack(df, keep), False))


def _pack(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Set columns aside in one struct: no recipe step or learner can meet their names."""
    return df.withColumn("_kept", F.struct(*[column(c) for c in keep])) if keep else df


def _assemble(recipe: FittedRecipe, rows: DataFrame, training: bool) -> DataFrame:
    if not recipe.features:
        raise ValueError("the recipe leaves no predictor")
    vectors = VectorAssembler(
        inputCols=recipe.features, outputCol="_vector", handleInvalid="keep"
    ).transform(recipe.apply(rows, training))
    own = [c for c in ("_kept", "_label") if c in rows.columns]
    named = [F.col(c).alias("label") if c == "_label" else c for c in own]
    return vectors.select(*named, F.col("_vector").alias("features"))


class _Shared:
    """Cached rows that several results use; the last one to be released gives them back."""

    def __init__(self, cached: list[DataFrame], users: int) -> None:
        self.cached, self.users = cached, users

    def release(self) -> None:
        self.users -= 1
        if self.users <= 0:
            self.drop()

    def drop(self) -> None:
        for df in self.cached:
            df.unpersist()
        self.cached = []


@dataclass
class TrainResult:
    model: FittedModel
    train_data: DataFrame
    test_data: DataFrame
    predictions: DataFrame
    cv_metrics: DataFrame | None
    test_metrics: DataFrame
    importance: DataFrame | None
    engine: str
    task_type: str
    target: str
    warnings: list[str]
    n_train: int
    n_test: int
    stratified: bool
    cv_stratified: bool
    split_message: str | None
    trained_schema: T.StructType = field(default_factory=T.StructType)
    _held: list[DataFrame] = field(default_factory=list, repr=False)
    _shared: _Shared | None = field(default=None, repr=False)

    def release(self) -> None:
        """Give back the cached training and prediction rows."""
        for df in self._held:
            df.unpersist()
        if self._shared is not None:
            self._shared.release()
            self._shared = None


def _class_levels(df: DataFrame, target: str) -> list[Any]:
    """Sorted class values; a class task has few, and more than ``MAX_CLASSES`` is refused."""
    rows = df.select(column(target)).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"target '{target}' has more than {MAX_CLASSES} classes")
    return sorted(r[0] for r in rows)


def _label(df: DataFrame, target: str, levels: list[Any], task_type: str):
    if task_type == REGRESSION:
        return present_double(df, target)
    known = F.array(*[F.lit(v) for v in levels])
    return (F.array_position(known, column(target)) - 1).cast("double")


def _fit_recipes(
    recipe: Recipe, rows: DataFrame, engines: Sequence[str], parts: dict[Any, int]
) -> tuple[dict[tuple[bool, Any], FittedRecipe], list[str]]:
    """The recipe fitted on every training part, addressed by (levels coded, part).

    ``parts`` maps None (all rows) and folds (the rows of the other folds) to row counts. The
    coded form, with level positions for trees, is there where the recipe leaves text columns,
    whose names are returned as well.
    """
    plain = fit_parts(recipe, rows, "_fold", parts)
    found = {(False, part): fitted for part, fitted in plain.items()}
    fixed, empty = [recipe.target, *recipe.ids], rows.limit(0)
    left = {c: None for f in plain.values() for c in columns_of(f.apply(empty), CATEGORICAL, exclude=fixed)}
    if left and set(engines) & set(TREE_ENGINES):
        coded = Recipe(recipe.target, [*recipe.steps, IntegerEncode(list(left))], recipe.ids)
        found |= {(True, part): fitted for part, fitted in fit_parts(coded, rows, "_fold", parts).items()}
    return found, list(left)


def _form(engine: str, left: Sequence[str]) -> bool:
    """Which form of the recipe an engine reads: the coded one where a tree meets text."""
    if left and engine not in TREE_ENGINES:
        raise ValueError(f"engine '{engine}' needs numbers; encode {', '.join(left)}")
    return bool(left)


def _fit(
    recipe: FittedRecipe,
    features: DataFrame,
    engine: str,
    task_type: str,
    target: str,
    levels: list[Any],
    params: dict[str, Any],
    n_rows: int,
) -> FittedModel:
    return _fit_all(recipe, features, engine, task_type, target, levels, [params], n_rows)[0]


def _fit_all(
    recipe: FittedRecipe,
    features: DataFrame,
    engine: str,
    task_type: str,
    target: str,
    levels: list[Any],
    settings: Sequence[dict[str, Any]],
    n_rows: int,
) -> list[FittedModel]:
    """A model per setting; an estimator that can learns all of them at once."""
    sizes = {"n_classes": max(len(levels), 2), "n_inputs": len(recipe.features), "n_rows": n_rows}
    makers = [make_estimator(engine, task_type, params, **sizes) for params in settings]
    if isinstance(makers[0], PrunedTree):
        learners = makers[0].fit_all(features, [m.params for m in makers])
    else:
        learners = [m.fit(features) for m in makers]
    return [
        FittedModel(recipe, learner, engine, task_type, target, levels, params)
        for learner, params in zip(learners, settings)
    ]


def _features(
    recipe: FittedRecipe, rows: DataFrame, label, keep: Sequence[str], training: bool, n_rows: int
) -> DataFrame:
    """Packed ``keep`` columns, ``label`` and ``features``, ready to be cached."""
    # learners run many short jobs: few rows should not pay for many tasks each time
    rows = rows.coalesce(max(-(-n_rows // ROWS_PER_TASK), 1))
    return _assemble(recipe, _pack(rows.withColumn("_label", label), keep), training)


def tune(
    rows: DataFrame,
    recipe: Recipe,
    engine: str,
    task_type: str,
    *,
    levels: list[Any],
    grid: Sequence[dict[str, Any]],
    parallelism: int = PARALLEL_FITS,
) -> tuple[DataFrame, dict[str, Any]]:
    """Cross-validate every setting of one engine; ``rows`` has a ``_fold`` column.

    Returns the metrics per setting and the best setting.
    """
    sizes = _fold_sizes(rows)
    recipes, left = _fit_recipes(recipe, rows, [engine], _parts(sizes, whole=False))
    found = _cross_validate(
        rows, recipe.target, recipes, left, {engine: grid}, task_type,
        levels=levels, sizes=sizes, parallelism=parallelism,
    )[engine]
    if isinstance(found, Exception):
        raise found
    return found


def _fold_sizes(rows: DataFrame) -> dict[int, int]:
    return {r["_fold"]: r["count"] for r in rows.groupBy("_fold").count().collect()}


def _parts(sizes: dict[int, int], whole: bool = True) -> dict[Any, int]:
    """Row counts of the training parts: without each fold, and of all rows."""
    total = sum(sizes.values())
    return ({None: total} if whole else {}) | {f: total - n for f, n in sorted(sizes.items())}


def _cross_validate(
    rows: DataFrame,
    target: str,
    recipes: dict[tuple[bool, Any], FittedRecipe],
    left: Sequence[str],
    grids: dict[str, Sequence[dict[str, Any]]],
    task_type: str,
    *,
    levels: list[Any],
    sizes: dict[int, int],
    parallelism: int,
) -> dict[str, tuple[DataFrame, dict[str, Any]] | Exception]:
    """Metrics of every setting and the best one, per engine, or why an engine has none.

    The features of a fold are made once and cached while all engines and settings learn from
    them; one aggregation per engine evaluates its settings. On few rows folds run side by side.
    """
    spark = rows.sparkSession
    label = _label(rows, target, levels, task_type)
    total = sum(sizes.values())
    failed: dict[str, Exception] = {}
    forms: dict[str, bool] = {}
    for engine in grids:
        try:
            forms[engine] = _form(engine, left)
        except ValueError as error:
            failed[engine] = error

    def run_fold(fold: int) -> list[tuple[str, str, str, float]]:
        part = rows.filter(F.col("_fold") != fold)
        held = rows.filter(F.col("_fold") == fold)
        n_part = total - sizes[fold]
        found, cached = [], {}
        try:
            for coded in dict.fromkeys(forms.values()):
                fitted = recipes[coded, fold]
                cached[coded] = (
                    _features(fitted, part, label, [], True, n_part).persist(STORAGE),
                    _features(fitted, held, label, [target], False, sizes[fold]).persist(STORAGE),
                )

            def run(job: tuple[str, list[int]]) -> list[tuple[str, DataFrame | None]]:
                engine, numbers = job
                learn, check = cached[forms[engine]]
                try:
                    models = _fit_all(
                        recipes[forms[engine], fold], learn, engine, task_type, target, levels,
                        [grids[engine][i] for i in numbers], n_part,
                    )
                except Exception as error:
                    failed.setdefault(engine, error)
                    return [(engine, None)]
                return [
                    (engine, m.score(check).withColumn("_config", F.lit(str(i)))) for i, m in zip(numbers, models)
                ]

            # the settings of a pruned tree come from one tree, others are learned one by one
            jobs = [
                (e, numbers)
                for e in forms
                for numbers in ([list(range(len(grids[e])))] if e == "rpart" else [[i] for i in range(len(grids[e]))])
            ]
            with ThreadPoolExecutor(max_workers=parallelism) as pool:
                scored = [one for found in pool.map(run, jobs) for one in found]
            for engine in forms:
                mine = [df for e, df in scored if e == engine]
                if engine in failed or any(df is None for df in mine):
                    continue
                together = mine[0]
                for one in mine[1:]:
                    together = together.unionByName(one)
                if task_type == CLASSIFICATION:  # its metrics read the scores several times
                    together = together.persist(STORAGE)
                try:
                    metrics = metric_set(
                        together, target, "prediction", task_type,
                        probability="probability" if task_type == CLASSIFICATION else None,
                        levels=levels or None, by=["_config"], group_rows=sizes[fold],
                    )
                    found += [(engine, r["_config"], r.metric, r.estimate) for r in metrics.collect()]
                finally:
                    together.unpersist()
            return found
        finally:
            for pair in cached.values():
                for df in pair:
                    df.unpersist()

    values: dict[str, dict[tuple[str, str], list[float]]] = {e: {} for e in forms}
    # many rows fill the cluster with one fold, and one fold at a time is cached then
    side_by_side = parallelism if total <= PARALLEL_FOLD_ROWS else 1
    with ThreadPoolExecutor(max_workers=side_by_side) as pool:
        for found in pool.map(run_fold, sorted(sizes)):  # engines x settings x metrics per fold
            for engine, config, metric, estimate in found:
                values[engine].setdefault((config, metric), []).append(estimate)
    out: dict[str, tuple[DataFrame, dict[str, Any]] | Exception] = dict(failed)
    for engine, per in values.items():
        if engine in failed:
            continue
        table = []
        for (config, metric), estimates in sorted(per.items()):
            n = len(estimates)
            mean = sum(estimates) / n
            spread = (sum((e - mean) ** 2 for e in estimates) / (n - 1)) ** 0.5 if n > 1 else None
            table.append((config, metric, mean, None if spread is None else spread / n**0.5, n))
        metrics = spark.createDataFrame(table, CV_SCHEMA)
        out[engine] = metrics, grids[engine][int(select_best(table, task_type))]
    return out


def select_best(table: Sequence[tuple], task_type: str) -> str:
    """Setting with the lowest RMSE, or the highest AUC (accuracy if there is none)."""
    if task_type == REGRESSION:
        choices = [(mean, config) for config, metric, mean, *_ in table if metric == "rmse"]
        return min(choices, key=lambda c: (c[0], int(c[1])))[1]
    for wanted in ("roc_auc", "accuracy"):
        choices = [(mean, config) for config, metric, mean, *_ in table if metric == wanted]
        if choices:
            return max(choices, key=lambda c: (c[0], -int(c[1])))[1]
    raise ValueError("no metric to choose a setting by")


def cv_metrics(
    rows: DataFrame, recipe: Recipe, engine: str, task_type: str, params: dict[str, Any],
    levels: list[Any],
) -> DataFrame:
    """Fold means of every metric for one setting; ``rows`` has a ``_fold`` column."""
    table, _ = tune(rows, recipe, engine, task_type, levels=levels, grid=[params])
    return table


def train(
    df: DataFrame,
    target: str,
    engine: str,
    task_type: str,
    recipe: Recipe | None = None,
    cv_folds: int = FOLDS,
    tune_grid: int = TRAIN_GRID,
    *,
    key: str | Sequence[str] | None = None,
    balance: str = "none",
    params: dict[str, Any] | None = None,
    parallelism: int = PARALLEL_FITS,
) -> TrainResult:
    """Train one engine end to end.

    ``key`` columns identify a row: they steer the split and are not predictors. The
    recipe and the class balance use training rows only. ``params`` are held fixed in
    every setting tried.
    """
    results, failures = _train_all(
        df, target, [engine], task_type, recipe, cv_folds, tune_grid,
        key=key, balance=balance, params=params, parallelism=parallelism,
    )
    if failures:
        raise failures[engine]
    return results[engine]


def _train_all(
    df: DataFrame,
    target: str,
    engines: Sequence[str],
    task_type: str,
    recipe: Recipe | None = None,
    cv_folds: int = FOLDS,
    tune_grid: int = TRAIN_GRID,
    *,
    key: str | Sequence[str] | None = None,
    balance: str = "none",
    params: dict[str, Any] | None = None,
    parallelism: int = PARALLEL_FITS,
    progress: Callable[[float, str], None] | None = None,
) -> tuple[dict[str, TrainResult], dict[str, Exception]]:
    """Results per engine and errors per engine that failed.

    Split, folds, fitted recipes and features are made once, whatever the number of engines.
    """
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    failures: dict[str, Exception] = {}
    for engine in engines:
        try:
            check_engine(engine, task_type)
        except ValueError as error:
            failures[engine] = error
    usable = [e for e in engines if e not in failures]
    if not usable:
        return {}, failures
    ids = [] if key is None else key_columns(df, key)
    taken = {"prediction", "probability"} & {target, *ids} | {"is_train"} & set(df.columns)
    if taken:
        raise ValueError(f"rename the columns {sorted(taken)}: the results use these names")
    df, nested = drop_nested(df)
    notes = [f"nested columns are not used: {', '.join(nested)}"] if nested else []
    rows = df.filter(~missing(df, target))
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        parts: Split = split(rows, target, task_type, key=key)
    notes += [str(w.message) for w in caught if w.category is UserWarning]
    # the split is a function of the rows: only the training side is cached, and the test
    # side is derived again when it is scored
    train_rows, test_rows = parts.train, parts.test
    stratify = target if task_type == CLASSIFICATION and parts.stratified else None
    folded = assign_folds(train_rows, cv_folds, key, stratify=stratify, name="_fold")
    if balance != "none":
        if balance not in ("oversample", "undersample"):
            raise ValueError(f"unknown balance '{balance}'")
        balanced = oversample if balance == "oversample" else undersample
        # folds are dealt first, so copies of a row share its fold
        folded = balanced(folded, target, key=key or key_columns(train_rows, None))
    shared = _Shared([folded.persist(STORAGE)], len(usable))
    learning: dict[bool, DataFrame] = {}
    results: dict[str, TrainResult] = {}
    try:
        used = recipe or default_recipe(target)
        used = Recipe(used.target, used.steps, sorted({*used.ids, *ids, "_fold"}))
        fixed = params or {}
        grids: dict[str, list[dict[str, Any]]] = {}
        for engine in usable:
            best = {**DEFAULTS.get(engine, {}), **fixed}
            grids[engine] = [best]
            if has_tunables(engine) and tune_grid > 0:
                grids[engine] = [{**best, **s, **fixed} for s in tuning_grid(engine, tune_grid)]
        sizes = _fold_sizes(folded)
        n_train = sum(sizes.values())
        levels = _class_levels(folded, target) if task_type == CLASSIFICATION else []
        label = _label(folded, target, levels, task_type)
        recipes, left = _fit_recipes(used, folded, usable, _parts(sizes))
        tuned = _cross_validate(
            folded, target, recipes, left, grids, task_type,
            levels=levels, sizes=sizes, parallelism=parallelism,
        )
        kept = [*dict.fromkeys([*ids, target])]
        for seq, engine in enumerate(engines, 1):
            if progress is not None:
                progress(seq / len(engines), f"training {engine}")
            if engine in failures:
                continue
            try:
                coded = _form(engine, left)
                own_notes, table, best = list(notes), None, grids[engine][0]
                if isinstance(tuned[engine], Exception):
                    if not isinstance(tuned[engine], ESTIMATOR_ERRORS):
                        raise tuned[engine]
                    # settings that cannot be learned are no reason to stop: train with the defaults
                    own_notes.append(f"tuning failed, defaults are used: {tuned[engine]}")
                else:
                    table, best = tuned[engine]
                    chosen = str(grids[engine].index(best))
                    table = table.filter(F.col("config") == chosen)
                fitted = recipes[coded, None]
                fitted.ids = [c for c in fitted.ids if c != "_fold"]
                if coded not in learning:
                    learning[coded] = _features(fitted, folded, label, [], True, n_train).persist(STORAGE)
                held = [learning[coded]] if engine == "kknn" else []  # it reads its rows when it predicts
                model = _fit(fitted, learning[coded], engine, task_type, target, levels, best, n_train)
                predictions = model.predict(test_rows, kept).persist(STORAGE)
                held.append(predictions)
                n_test = predictions.count()
                metrics = metric_set(
                    predictions, target, "prediction", task_type,
                    probability="probability" if task_type == CLASSIFICATION else None,
                    levels=levels or None, group_rows=n_test,
                )
                # at most five rows: keep their values, not the plan behind them
                spark = df.sparkSession
                metrics = spark.createDataFrame([tuple(r) for r in metrics.collect()], METRIC_SCHEMA)
                results[engine] = TrainResult(
                    model=model,
                    train_data=train_rows,
                    test_data=test_rows,
                    predictions=predictions,
                    cv_metrics=table,
                    test_metrics=metrics,
                    importance=importance(spark, model),
                    engine=engine,
                    task_type=task_type,
                    target=target,
                    warnings=list(dict.fromkeys(own_notes)),
                    n_train=n_train,
                    n_test=n_test,
                    stratified=parts.stratified,
                    cv_stratified=stratify is not None,
                    split_message=parts.message,
                    trained_schema=df.schema,
                    _held=held,
                    _shared=shared,
                )
            except Exception as error:
                failures[engine] = error
                shared.release()
        return results, failures
    except Exception:
        for result in results.values():
            result.release()
        shared.drop()
        raise
    finally:
        kept_rows = {id(x) for r in results.values() for x in r._held}
        for cached in learning.values():
            if id(cached) not in kept_rows:
                cached.unpersist()


def importance(spark: SparkSession, model: FittedModel) -> DataFrame | None:
    """Native importance of all features that have any, largest first: impurity of trees,
    |coefficient| of linear learners."""
    learner = model.learner
    names = model.recipe.features
    if isinstance(learner, PipelineModel):
        last = learner.stages[-1]
        if not isinstance(last, (PrunedLeaves, GrownTrees)):
            return None
        scores = last.getOrDefault(last.importances)
    elif hasattr(learner, "featureImportances"):
        scores = learner.featureImportances.toArray().tolist()
    elif hasattr(learner, "coefficientMatrix"):
        # one row per class: the strongest effect over the classes
        scores = abs(learner.coefficientMatrix.toArray()).max(axis=0).tolist()
    elif hasattr(learner, "coefficients"):
        scores = abs(learner.coefficients.toArray()).tolist()
    elif hasattr(learner, "models") and hasattr(learner.models[0], "featureImportances"):
        each = [m.featureImportances.toArray() for m in learner.models]
        scores = (sum(each) / len(each)).tolist()
    else:
        return None
    rows = sorted(
        ((n, float(s)) for n, s in zip(names, scores) if s > 0), key=lambda r: (-r[1], r[0])
    )
    return spark.createDataFrame(rows, "variable string, importance double")


def permutation_importance(
    model: FittedModel,
    df: DataFrame,
    key: str | Sequence[str],
    metric: str | None = None,
    *,
    seed: int = 123,
    bucket_rows: int = PERMUTATION_BUCKET_ROWS,
) -> DataFrame:
    """Loss of a metric when one input column is shuffled, for any learner.

    ``key`` must identify a row. Rows fall into hash buckets of bounded size; in each
    bucket the value of the next row in hash order is taken, so one shuffle permutes
    every column and no value is lost or invented.
    """
    keys = key_columns(df, key)
    target = model.target
    metric = metric or ("rmse" if model.task_type == REGRESSION else "accuracy")
    rows = df.filter(~missing(df, target))
    total = rows.count()
    inputs = [c for c in drop_nested(df)[0].columns if c not in (target, *keys)]
    buckets = max(1, total // bucket_rows)
    hashed = rows.withColumn("_hash", row_hash(keys, seed))
    order = Window.partitionBy(F.pmod(row_hash(keys, seed + 1), F.lit(buckets))).orderBy(
        "_hash", *[column(k) for k in keys], content_hash(rows)
    )
    packed = F.struct(*[column(c) for c in inputs])
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swapped = hashed.withColumn(
        "_next", F.coalesce(F.lead(packed).over(order), F.first(packed).over(whole))
    ).persist(STORAGE)
    try:
        parts = [model.predict(swapped, [target]).withColumn("_variable", F.lit(None).cast("string"))]
        for c in inputs:
            changed = swapped.withColumn(c, F.col("_next")[c])
            parts.append(model.predict(changed, [target]).withColumn("_variable", F.lit(c)))
        together = parts[0]
        for part in parts[1:]:
            together = together.unionByName(part)
        found = metric_set(
            together, target, "prediction", model.task_type,
            levels=model.levels or None, by=["_variable"],
        ).filter(F.col("metric") == metric)
        values = {r["_variable"]: r.estimate for r in found.collect()}  # one row per column
    finally:
        swapped.unpersist()
    base = values.pop(None)
    sign = 1 if model.task_type == REGRESSION and metric != "rsq" else -1
    table = sorted(
        ((c, sign * (v - base)) for c, v in values.items()), key=lambda r: (-r[1], r[0])
    )
    return df.sparkSession.createDataFrame(table, "variable string, importance double")


@dataclass
class Comparison:
    models: dict[str, TrainResult]
    table: DataFrame
    best_model: str | None
    task_type: str
    failures: dict[str, str]

    def release(self) -> None:
        for result in self.models.values():
            result.release()


def compare(
    df: DataFrame,
    target: str,
    task_type: str,
    engines: Sequence[str] = tuple(COMPARE_ENGINES),
    recipe: Recipe | None = None,
    cv_folds: int = FOLDS,
    tune_grid: int = COMPARE_GRID,
    progress: Callable[[float, str], None] | None = None,
    **options: Any,
) -> Comparison:
    """Train several engines on the same split; an engine that fails is left out."""
    results, errors = _train_all(
        df, target, engines, task_type, recipe, cv_folds, tune_grid, progress=progress, **options
    )
    failures = {engine: str(error) for engine, error in errors.items()}
    for engine, error in failures.items():
        warnings.warn(f"training {engine} failed: {error}", stacklevel=2)
    if not results:
        raise ValueError(f"no engine could be trained: {failures}")
    metrics = None
    for seq, (engine, result) in enumerate(results.items()):
        part = result.test_metrics.withColumns({"model": F.lit(engine), "seq": F.lit(seq)})
        metrics = part if metrics is None else metrics.unionByName(part)
    table = rank_models(comparison_table(metrics), task_type)
    best = table.filter("rank = 1").first()
    return Comparison(results, table, best.model if best else None, task_type, failures)


def comparison_table(metrics: DataFrame) -> DataFrame:
    """One row per model and one column per metric; ``seq`` is the listing order."""
    names = ["rmse", "rsq", "mae", "accuracy", "precision", "recall", "f_meas", "roc_auc"]
    present = {r.metric for r in metrics.select("metric").distinct().collect()}
    wide = metrics.groupBy("model", "seq").pivot("metric", [n for n in names if n in present])
    return wide.agg(F.first("estimate"))


def rank_models(table: DataFrame, task_type: str) -> DataFrame:
    """Best first: r-squared or accuracy, else the listing order. One row per model."""
    wanted = "rsq" if task_type == REGRESSION else "accuracy"
    order = [F.desc_nulls_last(wanted)] if wanted in table.columns else []
    window = Window.partitionBy(F.lit(0)).orderBy(*order, "seq")
    return table.withColumn("rank", F.row_number().over(window)).orderBy("rank")


def save_model(model: FittedModel, path: str) -> None:
    """Recipe and settings as one text file, the learner next to it."""
    spark = SparkSession.active()
    about = {
        "recipe": model.recipe.to_json(), "engine": model.engine, "task_type": model.task_type,
        "target": model.target, "levels": model.levels, "params": model.params,
    }
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/about")
    if isinstance(model.learner, NeighbourVoteModel):
        model.learner.save(f"{path}/learner")
    else:
        stage = model.learner
        if not isinstance(stage, PipelineModel):
            stage = PipelineModel([stage])
        stage.write().overwrite().save(f"{path}/learner")


def load_model(spark: SparkSession, path: str) -> FittedModel:
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    levels, task_type = about["levels"], about["task_type"]
    if about["engine"] == "kknn":
        params = about["params"]  # models saved before there were weights have plain votes
        learner: Any = NeighbourVoteModel.load(
            spark, f"{path}/learner", task_type, int(params["k"]), max(len(levels), 2),
            params.get("weights", "rectangular"),
        )
    else:
        learner = PipelineModel.load(f"{path}/learner")
    return FittedModel(
        FittedRecipe.from_json(about["recipe"]), learner, about["engine"], task_type,
        about["target"], levels, about["params"],
    )
