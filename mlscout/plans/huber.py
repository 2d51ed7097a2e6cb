"""Huber regression on random Fourier features, without storing the mapped rows.

The mapped rows are many times as wide as the rows, so each pass maps them again, batch by batch,
and sums up what a Newton step needs: products of the mapped columns over the rows near the fit,
signs over the others. Such sums add up in a tree of tasks; what reaches the driver is a matrix of
the mapped columns, whatever the number of rows. The objective is that of Spark's linear regression
with ``loss="huber"``: scale and coefficients are found together, the intercept is free, and the
penalty is on coefficients of standardised columns. A few steps end where its gradient is zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 1.35
STEPS = 100
TOLERANCE = 1e-9  # what a last step may still have to gain, as a share of the loss
BLOCK_CELLS = 1 << 20  # mapped values held at once
FAN_IN = 64


def fourier_weights(width: int, gamma: float, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    weights = random.normal(0, np.sqrt(2 * gamma), (width, size))
    return weights, random.uniform(0, 2 * np.pi, size)


def fourier_map(rows: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    mapped = rows @ weights
    mapped += shift
    np.cos(mapped, out=mapped)
    mapped *= np.sqrt(2 / len(shift))
    return mapped


def array_rows(lists: pa.Array) -> np.ndarray:
    """The rows of an Arrow array of equally long lists."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class FourierRegression(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Predictions of a linear function of the Fourier map of ``features``."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of the map", TypeConverters.toInt)
    slopes = Param(Params._dummy(), "slopes", "one per mapped column", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "constant", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, gamma=None, seed=None, slopes=None, intercept=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, seed = self.getOrDefault("gamma"), self.getOrDefault("seed")
        slopes, intercept = np.array(self.getOrDefault("slopes")), self.getOrDefault("intercept")

        @F.arrow_udf("double")
        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            made = None
            for batch in batches:
                if len(batch) == 0:
                    yield pa.array([], pa.float64())
                    continue
                rows = array_rows(batch)
                made = made or fourier_weights(rows.shape[1], gamma, len(slopes), seed)
                yield pa.array(fourier_map(rows, *made) @ slopes + intercept)

        return dataset.withColumn("prediction", predict(vector_to_array("features")))


class FourierHuber:
    """Fits Huber regression with a penalty on the Fourier map of ``features``."""

    def __init__(self, gamma: float, size: int, seed: int, penalty: float) -> None:
        self.gamma, self.size, self.seed, self.penalty = gamma, size, seed, penalty

    def fit(self, features: DataFrame) -> PipelineModel:
        rows = features.select(
            vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")
        )
        slopes, intercept = self._solve(rows)
        model = FourierRegression(gamma=self.gamma, seed=self.seed, slopes=slopes, intercept=intercept)
        return PipelineModel([model])

    def _solve(self, rows: DataFrame) -> tuple[list[float], float]:
        # all rows near: what least squares needs
        near, _, _ = self._sums(rows, None, np.inf)
        n, products, crossed = near[-2, -2], near[:-1, :-1], near[:-1, -1]
        mean = products[-1, :-1] / n
        spread = np.maximum(np.diag(products)[:-1] / n - mean * mean, 0.0) * n / max(n - 1, 1)
        penalty = np.diag(np.append(self.penalty * spread, 0.0))
        at = np.linalg.lstsq(products, crossed, rcond=None)[0]
        left = near[-1, -1] - 2 * at @ crossed + at @ products @ at
        scale = np.sqrt(max(left / n, 1e-12 * near[-1, -1] / n)) or 1.0
        place, step, share, before, slope = np.append(at, scale), None, 1.0, np.inf, 0.0
        for _ in range(STEPS):
            coefficients, scale = place[:-1], place[-1]
            loss, gradient, curvature = self._expand(self._sums(rows, coefficients, scale), n, place, penalty)
            if step is not None and loss > before + 1e-4 * share * slope + 1e-12 * abs(before):
                share /= 2  # too far: the sums of the other rows have changed on the way
                if share < 1e-6:
                    return self._found(place - share * 2 * step)
                place = place - share * step
                continue
            step = np.linalg.lstsq(curvature, -gradient, rcond=None)[0]
            slope, before, share = float(gradient @ step), loss, 1.0
            if step[-1] < -0.9 * scale:  # the scale stays positive
                share = 0.9 * scale / -step[-1]
            place = place + share * step
            if -slope <= TOLERANCE * abs(loss):
                break
        return self._found(place)

    @staticmethod
    def _found(place: np.ndarray) -> tuple[list[float], float]:
        return place[:-2].tolist(), float(place[-2])

    @staticmethod
    def _expand(sums, n: float, place: np.ndarray, penalty: np.ndarray):
        """Loss, gradient and curvature in the coefficients, the intercept and the scale."""
        near, signs, far = sums
        coefficients, scale = place[:-1], place[-1]
        products, crossed, squares, n_far = near[:-1, :-1], near[:-1, -1], near[-1, -1], n - near[-2, -2]
        loss = 0.5 * scale * n + 0.5 * squares / scale + EPSILON * far - 0.5 * scale * EPSILON**2 * n_far
        pull = penalty @ coefficients
        gradient = np.append(
            (-crossed / scale - EPSILON * signs) / n + pull,
            (0.5 * n - 0.5 * squares / scale**2 - 0.5 * EPSILON**2 * n_far) / n,
        )
        mixed = (crossed / (n * scale**2))[:, None]
        curvature = np.block(
            [[products / (n * scale) + penalty, mixed], [mixed.T, np.array([[squares / (n * scale**3)]])]]
        )
        return loss / n + 0.5 * coefficients @ pull, gradient, curvature

    def _sums(self, rows: DataFrame, coefficients: np.ndarray | None, scale: float):
        """One pass: products of (mapped columns, 1, residual) over the rows near the fit; over the
        others the sums of (mapped columns, 1) by the sign of the residual, and of its size."""
        gamma, size, seed = self.gamma, self.size, self.seed
        width = size + 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, made = np.zeros(width * width + width), None
            for batch in batches:
                for at in range(0, batch.num_rows, max(1, BLOCK_CELLS // width)):
                    part = batch.slice(at, max(1, BLOCK_CELLS // width))
                    x = array_rows(part.column(0))
                    made = made or fourier_weights(x.shape[1], gamma, size, seed)
                    block = np.empty((len(x), width))
                    block[:, :size] = fourier_map(x, *made)
                    block[:, size] = 1.0
                    block[:, -1] = part.column(1).to_numpy(zero_copy_only=False)
                    if coefficients is not None:
                        block[:, -1] -= block[:, :-1] @ coefficients
                    away = np.abs(block[:, -1]) > EPSILON * scale
                    if away.any():
                        others, block = block[away], block[~away]
                        total[width * width : -1] += np.sign(others[:, -1]) @ others[:, :-1]
                        total[-1] += np.abs(others[:, -1]).sum()
                    total[: width * width] += (block.T @ block).ravel()
            if made is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["state"])

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
        total = np.sum(found, axis=0)
        if not found or not np.isfinite(total).all():
            raise ValueError("there are no rows, or features or labels that are not finite")
        square = total[: width * width].reshape(width, width)
        return square, total[width * width : -1], total[-1]
