"""Kernel machines over landmarks: a Nystrom map of any kernel, ridge and Gaussian-process regression in it.

A bounded number of candidate rows is drawn by keyed hashes of different rows (each task keeps the smallest keys, so the draw does not
depend on the layout). Of these, landmarks are drawn with chances in proportion to their ridge leverage. A row's features are its kernel
values with the landmarks, turned so that their inner products are the kernel; one scan then builds the Gram matrix of a ridge fit. With
every different row as a landmark the fit is the exact kernel machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double_sql
from tabreg.models.base import Fitted, FittedLinear, FittedMapped, Regressor
from tabreg.models.gram import grams, matrix, total
from tabreg.models.trees import mixed
from tabreg.operators.encode import fit_scaler

CANDIDATES = 4        # times the landmarks
SMALLEST = 1e-12      # share of the largest eigenvalue below which a direction of the landmarks' kernel is left out


def standard_units(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    s = fit_scaler(df, list(features), "standard")
    return np.array([s.shift[c] for c in features]), np.array([s.width[c] or 1.0 for c in features])


@dataclass
class Kernel:
    """linear: <x, z>; poly: (gamma <x, z> + coef0) ** degree; sigmoid: tanh(gamma <x, z> + coef0); rbf: exp(-gamma |x - z|^2)."""

    name: str
    gamma: float
    degree: int = 3
    coef0: float = 1.0

    def __call__(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        inner = x @ z.T
        if self.name == "linear":
            return inner
        if self.name == "poly":
            return (self.gamma * inner + self.coef0) ** self.degree
        if self.name == "sigmoid":
            return np.tanh(self.gamma * inner + self.coef0)
        if self.name == "rbf":
            far = (x * x).sum(1)[:, None] + (z * z).sum(1)[None, :]
            inner *= 2
            far -= inner
            np.maximum(far, 0.0, out=far)
            far *= -self.gamma
            return np.exp(far, out=far)
        raise ValueError(f"unknown kernel {self.name!r}")

    def own(self, x: np.ndarray) -> np.ndarray:
        """Each row's kernel with itself."""
        if self.name == "rbf":
            return np.ones(len(x))
        square = (x * x).sum(1)
        return square if self.name == "linear" else ((self.gamma * square + self.coef0) ** self.degree if self.name == "poly"
                                                     else np.tanh(self.gamma * square + self.coef0))


@dataclass
class LandmarkMap:
    """Rows to features whose inner products approximate the kernel. ``sign`` is -1 for directions of an indefinite kernel."""

    mean: np.ndarray
    wide: np.ndarray
    kernel: Kernel
    landmarks: np.ndarray
    turn: np.ndarray
    sign: np.ndarray

    @staticmethod
    def of(mean, wide, kernel: Kernel, landmarks: np.ndarray) -> LandmarkMap:
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
        keep = np.abs(values) > SMALLEST * np.abs(values).max(initial=0.0)
        values, vectors = values[keep], vectors[:, keep]
        return LandmarkMap(mean, wide, kernel, landmarks, vectors / np.sqrt(np.abs(values)), np.sign(values))

    def units(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.wide

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(self.units(x), self.landmarks) @ self.turn

    def along(self, coef: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """Rows to their features' product with ``coef``, without the features."""
        weight = self.turn @ coef
        return lambda x: self.kernel(self.units(x), self.landmarks) @ weight


def draw_candidates(df: DataFrame, features: Sequence[str], count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``count`` different rows with the smallest keyed hashes, and those hashes as numbers in [0, 1)."""
    p = len(features)
    view = df.select(*[F.expr(f"{clean_double_sql(c)} AS `{c}`") for c in features])
    view = view.select(*view.columns, F.xxhash64(*[F.col(f"`{c}`") for c in view.columns]).alias("__key"))

    def smallest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = np.empty(0), np.empty((0, p))
        for batch in batches:
            u = mixed(batch.column(p).to_numpy(zero_copy_only=False), seed)
            keys, first = np.unique(np.r_[keys, u], return_index=True)
            keys, first = keys[:count], first[:count]
            rows = np.r_[rows, matrix(batch, p)][first]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(rows), pa.list_(pa.float64()))], ["u", "x"])

    got = view.mapInArrow(smallest, "u double, x array<double>").groupBy("u").agg(F.first("x").alias("x")).orderBy("u").limit(count).collect()
    return np.array([r["x"] for r in got]).reshape(-1, p), np.array([r["u"] for r in got])


def landmark_map(df: DataFrame, features: Sequence[str], kernel: Kernel, count: int, ridge: float, seed: int,
                 units: tuple[np.ndarray, np.ndarray] | None = None) -> LandmarkMap:
    """``count`` landmarks, drawn by leverage from ``CANDIDATES`` times as many rows; all candidates if there are no more."""
    mean, wide = units or standard_units(df, features)
    rows, u = draw_candidates(df, features, CANDIDATES * count, seed)
    if not len(rows):
        raise ValueError("no rows to fit")
    z = (rows - mean) / wide
    if len(z) > count:
        k = kernel(z, z)
        leverage = np.clip(np.einsum("ij,ji->i", k, np.linalg.pinv(k + max(ridge, 1e-6) * np.eye(len(k)))), 1e-12, None)
        again = mixed((u * (1 << 53)).astype(np.uint64), seed, 1)
        z = z[np.sort(np.argsort(-np.log1p(-again) / leverage, kind="stable")[:count])]  # the keys of a weighted draw
    return LandmarkMap.of(mean, wide, kernel, z)


def width_of(gamma, p: int) -> float:
    return 1.0 / p if gamma in (None, "scale", "auto") else float(gamma)


class KernelRidge(Regressor):
    """Ridge in a kernel's features, in standard units and without an intercept: exact for 'linear', else over ``components`` landmarks
    (exact where the table has no more different rows)."""

    defaults: ClassVar[dict] = {"alpha": 1.0, "kernel": "linear", "gamma": "scale", "degree": 3, "coef0": 1.0, "components": 300, "random_state": 42}

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> Fitted:
        o = self.params
        if o["kernel"] == "linear":
            g = total(grams(df, features, target))
            c, v, _ = g.moments(False)
            return FittedLinear(features, np.linalg.solve(c + np.eye(len(v)) * o["alpha"] / g.n, v), 0.0)
        if o["kernel"] not in ("poly", "rbf", "sigmoid"):
            raise ValueError("kernel must be linear, poly, rbf or sigmoid")
        kernel = Kernel(o["kernel"], width_of(o["gamma"], len(features)), int(o["degree"]), float(o["coef0"]))
        made = landmark_map(df, features, kernel, int(o["components"]), float(o["alpha"]), int(o["random_state"] or 42))
        g = total(grams(df, features, target, mapper=made))
        c, v, _ = g.moments(False)
        coef = np.linalg.solve(c + np.diag(made.sign) * o["alpha"] / g.n, v)
        return FittedMapped(features, made, coef, 0.0)


class FittedProcess(FittedMapped):
    """The process' mean; ``predict_spread`` adds its standard deviation."""

    def __init__(self, features, mapper: LandmarkMap, coef, intercept: float, spread: np.ndarray, scale: float = 1.0):
        super().__init__(features, mapper, coef, intercept)
        self.spread, self.scale = spread, scale

    def predict_spread(self, df: DataFrame, name: str = "deviation") -> DataFrame:
        mapper, spread, scale = self.mapper, self.spread, self.scale

        @F.pandas_udf("double")
        def deviation(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in cols])
            phi = mapper(x)
            left = mapper.kernel.own(mapper.units(x)) - (phi * phi).sum(1) + ((phi @ spread) ** 2).sum(1)
            return pd.Series(scale * np.sqrt(np.maximum(left, 0.0)))

        return df.withColumn(name, deviation(*[F.expr(clean_double_sql(c)) for c in self.features]))


class GaussianProcess(Regressor):
    """Regression by a Gaussian process with an rbf kernel of a given length, over ``components`` landmarks. ``alpha`` is the variance of
    the noise. Prior mean 0 (or, with ``normalize_y``, the target's mean, in units of its deviation)."""

    defaults: ClassVar[dict] = {"alpha": 1e-10, "length_scale": 1.0, "normalize_y": False, "components": 300, "random_state": 42}

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> FittedProcess:
        o = self.params
        kernel = Kernel("rbf", 0.5 / float(o["length_scale"]) ** 2)
        made = landmark_map(df, features, kernel, int(o["components"]), float(o["alpha"]), int(o["random_state"] or 42))
        g = total(grams(df, features, target, mapper=made))
        c, v, _ = g.moments(False)
        centre, unit = (g.ymean, float(np.sqrt(max(g.variance, 0.0))) or 1.0) if o["normalize_y"] else (0.0, 1.0)
        if o["normalize_y"]:
            v = v - g.xmean * centre
        values, vectors = np.linalg.eigh(c)
        values = np.maximum(values, 0.0) + float(o["alpha"]) * 1.0 / g.n
        coef = vectors @ ((vectors.T @ v) / values)
        spread = vectors * np.sqrt(float(o["alpha"]) / g.n / values)  # alpha A^-1 = spread spread'
        return FittedProcess(features, made, coef, centre, spread, unit)
