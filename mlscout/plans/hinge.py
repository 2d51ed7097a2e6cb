"""Machines with hinge loss on random Fourier features, without storing the mapped rows.

Each pass maps the rows again, batch by batch, and sums up for all classes what a Newton step needs,
so neither mapped rows nor a copy of the rows per class is kept. The objective is that of Spark's
``LinearSVC``: mean hinge loss plus a penalty on coefficients of standardised columns, the intercept
free, one class against the others. Newton steps need a curvature, so the corner of the hinge is
rounded within ``h``, which changes the mean loss by at most ``h / 4`` times the share of rows that
near. ``h`` falls from 1 to ``ROUNDED`` along the path of its solutions: a step also foresees how the
solution moves with ``h``. A pass tells the losses of several lengths of the step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlscout.plans.huber import FAN_IN, array_rows, fourier_map, fourier_weights

ROUNDED = 0.01  # how near the corner the hinge stays rounded
FALL = 0.2  # of the rounding from one solution to the next
STEPS = 60
TOLERANCE = 1e-5  # what a last step may still have to gain, as a share of loss and rounding
LENGTHS = np.append(0.0, 4.0 ** -np.arange(8))  # of a step, tried in one pass; the second is all of it
BLOCK_CELLS = 1 << 17  # mapped values held at once
STATE_CELLS = 1 << 22  # of the sums that a task holds; more classes are solved in turn


class FourierMachine(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``margin`` and ``prediction`` of linear functions of the Fourier map of ``features``.

    One function separates two classes; otherwise each class has its own.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of the map", TypeConverters.toInt)
    slopes = Param(Params._dummy(), "slopes", "one per mapped column, function by function", TypeConverters.toListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "one per function", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, gamma=None, seed=None, slopes=None, intercepts=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, seed = self.getOrDefault("gamma"), self.getOrDefault("seed")
        intercepts = np.array(self.getOrDefault("intercepts"))
        slopes = np.array(self.getOrDefault("slopes")).reshape(len(intercepts), -1)

        @F.arrow_udf("array<double>")
        def margins(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            made = None
            for batch in batches:
                if len(batch) == 0:
                    yield pa.array([], pa.list_(pa.float64()))
                    continue
                rows = array_rows(batch)
                made = made or fourier_weights(rows.shape[1], gamma, slopes.shape[1], seed)
                found = fourier_map(rows, *made) @ slopes.T + intercepts
                if len(intercepts) == 1:
                    found = np.hstack([-found, found])
                ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                yield pa.ListArray.from_arrays(ends, found.ravel())

        told = dataset.withColumn("_margins", margins(vector_to_array("features")))
        largest = F.array_position("_margins", F.array_max("_margins")) - 1
        return told.withColumn("prediction", largest.cast("double")).withColumn(
            "margin", array_to_vector("_margins")
        ).drop("_margins")


def _empty(n: int, width: int) -> dict[str, np.ndarray]:
    """Sums of ``n`` functions: losses by length of the step, the slope of the loss, its curvature and
    how its slope changes with the rounding."""
    return {
        "losses": np.zeros((n, len(LENGTHS))), "gradient": np.zeros((n, width)),
        "curvature": np.zeros((n, width, width)), "drift": np.zeros((n, width)),
    }


def add_block(total: dict[str, np.ndarray], block: np.ndarray, signs: np.ndarray, at, steps, h) -> None:
    """Add the rows of a block of mapped columns and ones; ``signs`` has a column per function."""
    begun = signs * (block @ at.T)
    moved = signs * (block @ steps.T)
    for j in range(len(at)):
        y = signs[:, j]
        short = 1.0 - begun[:, j] - moved[:, j]  # of the margin, after all of the step
        for i, length in enumerate(LENGTHS):
            left = short if length == 1.0 else 1.0 - begun[:, j] - length * moved[:, j]
            # the rounded hinge is a parabola between -h and h
            inside = np.clip(left + h[j], 0.0, 2 * h[j])
            total["losses"][j, i] += inside @ inside / (4 * h[j]) + np.maximum(left - h[j], 0.0).sum()
        total["gradient"][j] -= (np.clip((short + h[j]) / (2 * h[j]), 0.0, 1.0) * y) @ block
        near = np.abs(short) < h[j]
        rows = block if near.all() else block[near]
        total["curvature"][j] += rows.T @ rows / (2 * h[j])
        total["drift"][j] += (short[near] * y[near] / (2 * h[j] ** 2)) @ rows


class HingePath:
    """The search for one function: where it stands, the step it tries and the rounding ``h``."""

    def __init__(self, at: np.ndarray, penalty: np.ndarray):
        self.at, self.penalty, self.h = at, penalty, 1.0
        self.step, self.done = np.zeros_like(at), False

    def told(self, n: float, losses, gradient, curvature, drift) -> None:
        """Go on from the sums of a pass at ``at + step``."""
        pulls = np.array([self.penalty @ (self.at + t * self.step) ** 2 for t in LENGTHS])
        losses = losses / n + 0.5 * pulls
        if losses[1] > losses[0] + 1e-12 * abs(losses[0]):
            best = int(np.argmin(losses))
            # a step too long; where none of the lengths gains, try shorter ones
            self.step = self.step * (LENGTHS[best] if best else LENGTHS[-1])
            if best or np.abs(self.step).max() > 1e-12 * (1 + np.abs(self.at).max()):
                return
            self.step = np.zeros_like(self.at)
            self._lower()
            return
        self.at = self.at + self.step
        gradient = gradient / n + self.penalty * self.at
        curvature = curvature / n + np.diag(self.penalty)
        step = -np.linalg.lstsq(curvature, gradient, rcond=1e-12)[0]
        gain = -0.5 * gradient @ step
        last = self.h <= ROUNDED
        if gain <= (TOLERANCE if last else 0.01) * (losses[1] + self.h):
            before = self.h
            self._lower()
            if not self.done:
                step = step - (self.h - before) * np.linalg.lstsq(curvature, drift / n, rcond=1e-12)[0]
        self.step = step

    def _lower(self) -> None:
        self.done = self.h <= ROUNDED
        self.h = max(self.h * FALL, ROUNDED)


class FourierHinge:
    """Fits hinge loss with a penalty on the Fourier map of ``features``, one class against the others,
    and the logistic scale of the margins that gives probabilities."""

    def __init__(self, gamma: float, size: int, seed: int, penalty: float, n_classes: int) -> None:
        self.gamma, self.size, self.seed, self.penalty, self.n_classes = gamma, size, seed, penalty, n_classes

    def fit(self, features: DataFrame) -> PipelineModel:
        rows = features.select(
            vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")
        )
        classes = list(range(self.n_classes)) if self.n_classes > 2 else [1]
        together = max(1, STATE_CELLS // (self.size + 1) ** 2)
        found = [
            f for a in range(0, len(classes), together) for f in self._solve(rows, classes[a : a + together])
        ]
        machine = FourierMachine(
            gamma=self.gamma, seed=self.seed, slopes=[v for f in found for v in f[:-1].tolist()],
            intercepts=[float(f[-1]) for f in found],
        )
        scale = LogisticRegression(
            featuresCol="margin", predictionCol="scaled_prediction", rawPredictionCol="scaled_raw",
            probabilityCol="probability", family="multinomial", regParam=1e-6,
        )
        told = machine.transform(features).select("margin", "label")
        return PipelineModel([machine, scale.fit(told)])

    def _solve(self, rows: DataFrame, classes: Sequence[int]) -> list[np.ndarray]:
        products, crossed = self._squares(rows, classes)
        n = products[-1, -1]
        mean = products[-1, :-1] / n
        spread = np.maximum(np.diag(products)[:-1] / n - mean * mean, 0.0) * n / max(n - 1, 1)
        penalty = np.append(self.penalty * spread, 0.0)
        # least squares is where the path begins
        begin = np.linalg.lstsq(products / n + np.diag(penalty), crossed / n, rcond=None)[0].T
        paths = [HingePath(2 * w, penalty) for w in begin]
        for _ in range(STEPS):
            going = [j for j, p in enumerate(paths) if not p.done]
            if not going:
                break
            sums = self._sums(rows, [classes[j] for j in going], [paths[j] for j in going])
            for i, j in enumerate(going):
                paths[j].told(n, *(sums[k][i] for k in ("losses", "gradient", "curvature", "drift")))
        return [p.at for p in paths]

    def _squares(self, rows: DataFrame, classes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        width = self.size + 1

        def add(total, block, labels):
            total["products"] += block.T @ block
            total["crossed"] += block.T @ np.where(labels[:, None] == classes, 1.0, -1.0)

        def empty():
            return {"products": np.zeros((width, width)), "crossed": np.zeros((width, len(classes)))}

        total = self._total(rows, empty, add)
        return total["products"], total["crossed"]

    def _sums(self, rows: DataFrame, classes: Sequence[int], paths: Sequence[HingePath]) -> dict[str, np.ndarray]:
        """One pass for all functions that still move."""
        width = self.size + 1
        at, steps = np.array([p.at for p in paths]), np.array([p.step for p in paths])
        h = [p.h for p in paths]

        def add(total, block, labels):
            add_block(total, block, np.where(labels[:, None] == classes, 1.0, -1.0), at, steps, h)

        return self._total(rows, lambda: _empty(len(paths), width), add)

    def _total(self, rows: DataFrame, empty, add) -> dict[str, np.ndarray]:
        """Sums over all rows, mapped block by block; they add up in a tree of tasks."""
        gamma, size, seed = self.gamma, self.size, self.seed
        height = max(1, BLOCK_CELLS // (size + 1))

        def packed(total: dict[str, np.ndarray]) -> pa.RecordBatch:
            flat = np.concatenate([v.ravel() for v in total.values()])
            return pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], ["state"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, made = empty(), None
            for batch in batches:
                for a in range(0, batch.num_rows, height):
                    part = batch.slice(a, height)
                    x = array_rows(part.column(0))
                    made = made or fourier_weights(x.shape[1], gamma, size, seed)
                    block = np.empty((len(x), size + 1))
                    block[:, :size] = fourier_map(x, *made)
                    block[:, size] = 1.0
                    add(total, block, part.column(1).to_numpy(zero_copy_only=False))
            if made is not None:
                yield packed(total)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    total = np.frombuffer(raw) if total is None else total + np.frombuffer(raw)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["state"])

        fan = min(FAN_IN, rows.sparkSession.sparkContext.defaultParallelism)
        states = rows.mapInArrow(run, "state binary").repartition(fan).mapInArrow(added, "state binary")
        found = [np.frombuffer(bytes(r.state)) for r in states.collect()]
        flat = np.sum(found, axis=0)
        if not found or not np.isfinite(flat).all():
            raise ValueError("there are no rows, or features or labels that are not finite")
        out, begin = {}, 0
        for name, like in empty().items():
            out[name] = flat[begin : begin + like.size].reshape(like.shape)
            begin += like.size
        return out
