"""Additive sufficient statistics of least squares, one block per fold, from one scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double_sql

MAX_FEATURES = 2_000
MAPPED_CELLS = 1 << 18
Mapper = Callable[[np.ndarray], np.ndarray]
Adjust = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Gram:
    """Sums over rows of x - shift and y - shift; adding two blocks adds the rows."""

    n: float
    sx: np.ndarray
    sy: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    shift: np.ndarray
    yshift: float

    def __add__(self, o: "Gram") -> "Gram":
        return Gram(self.n + o.n, self.sx + o.sx, self.sy + o.sy, self.xx + o.xx, self.xy + o.xy,
                    self.yy + o.yy, self.shift, self.yshift)

    def __sub__(self, o: "Gram") -> "Gram":
        return Gram(self.n - o.n, self.sx - o.sx, self.sy - o.sy, self.xx - o.xx, self.xy - o.xy,
                    self.yy - o.yy, self.shift, self.yshift)

    def moments(self, centred: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
        """(X'X, X'y, y'y) / n about the means, or about zero."""
        xx, xy, yy = self.xx / self.n, self.xy / self.n, self.yy / self.n
        mx, my = self.sx / self.n, self.sy / self.n
        if centred:
            return xx - np.outer(mx, mx), xy - mx * my, yy - my * my
        s, t = self.shift, self.yshift
        return (xx + np.outer(mx, s) + np.outer(s, mx) + np.outer(s, s),
                xy + mx * t + s * my + s * t, yy + 2 * t * my + t * t)

    @property
    def xmean(self) -> np.ndarray:
        return self.sx / self.n + self.shift

    @property
    def ymean(self) -> float:
        return self.sy / self.n + self.yshift

    def intercept(self, coef: np.ndarray, fit_intercept: bool) -> float:
        return float(self.ymean - self.xmean @ coef) if fit_intercept else 0.0

    def mse(self, coef: np.ndarray, intercept: float) -> float:
        """Mean squared error of a linear rule on these rows."""
        c, v, w = self.moments(True)
        bias = self.ymean - self.xmean @ coef - intercept
        return float(max(w - 2 * coef @ v + coef @ c @ coef, 0.0) + bias * bias)

    @property
    def variance(self) -> float:
        return float(self.moments(True)[2])


def parts_of(batch: pa.RecordBatch, step: int | None) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``step`` rows: mapped rows then stay in a core's cache."""
    for at in range(0, batch.num_rows, step or max(batch.num_rows, 1)):
        yield batch.slice(at, step or batch.num_rows)


def matrix(batch: pa.RecordBatch, p: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)])


def numeric_view(df: DataFrame, features: Sequence[str], target: str, extra: Sequence[Column] = ()) -> DataFrame:
    return df.select(*[F.expr(f"{clean_double_sql(c)} AS x{i}") for i, c in enumerate(features)],
                     F.expr(f"{clean_double_sql(target)} AS y"), *extra)


def column_shift(df: DataFrame, features: Sequence[str], target: str) -> np.ndarray:
    row = df.agg(*[F.expr(f"avg({clean_double_sql(c)}) AS m{i}") for i, c in enumerate((*features, target))]).first()
    return np.array([v or 0.0 for v in row])


def grams(df: DataFrame, features: Sequence[str], target: str, fold: Column | None = None,
          weight: Column | None = None, mapper: Mapper | None = None, adjust: Adjust | None = None,
          centre: np.ndarray | None = None) -> dict[int, Gram]:
    """Per-fold blocks.  Tasks fold their Arrow batches into one block; Spark sums the blocks.

    ``adjust`` may give each row a weight and a working target (reweighted least squares)."""
    p = len(features)
    view = numeric_view(df, features, target, [(F.lit(0) if fold is None else fold).cast("int").alias("fold"),
                                               (F.lit(1.0) if weight is None else weight).cast("double").alias("w")])
    centre = column_shift(df, features, target) if centre is None else centre
    shift, yshift = centre[:p], float(centre[p])
    d = p if mapper is None else mapper(np.zeros((1, p))).shape[1]
    if d > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features: select or reduce them first")
    upper = np.triu_indices(d)
    step = max(256, MAPPED_CELLS // d) if mapper is not None else None

    plain, whole_batch = weight is None and adjust is None, fold is None  # tasks get flags: a Column cannot be sent

    def fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in (part for whole in batches for part in parts_of(whole, step)):
            x, y = matrix(batch, p), batch.column(p).to_numpy(zero_copy_only=False).astype(float)
            folds = batch.column(p + 1).to_numpy(zero_copy_only=False)
            w = batch.column(p + 2).to_numpy(zero_copy_only=False).astype(float)
            x = x if mapper is None else mapper(x)
            if adjust is not None:
                w, y = adjust(x, y)
            x = x - shift if mapper is None else x
            y = y - yshift
            if np.isnan(x).any() or np.isnan(y).any():
                raise ValueError("missing cells: impute before fitting")
            for f in np.unique(folds):
                m = slice(None) if whole_batch else folds == f
                xf, yf, wf = x[m], y[m], w[m]
                xw = xf if plain else xf * wf[:, None]  # a matrix times itself takes half the work
                block = np.concatenate([[wf.sum()], xw.sum(0), [(wf * yf).sum()], (xw.T @ xf)[upper], xw.T @ yf,
                                        [(wf * yf * yf).sum()]])
                blocks[int(f)] = blocks.get(int(f), 0.0) + block
        for f, block in blocks.items():
            k = len(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, f, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(block)],
                names=["fold", "k", "v"])

    rows = (view.mapInArrow(fold_rows, "fold int, k int, v double")
            .groupBy("fold", "k").agg(F.sum("v").alias("v")).toPandas())
    out = {}
    for f, part in rows.groupby("fold"):
        v = part.sort_values("k")["v"].to_numpy()
        xx = np.zeros((d, d))
        xx[upper] = v[d + 2:d + 2 + len(upper[0])]
        xx = xx + xx.T - np.diag(np.diag(xx))
        at = d + 2 + len(upper[0])
        out[int(f)] = Gram(v[0], v[1:d + 1], v[d + 1], xx, v[at:at + d], v[at + d],
                           shift if mapper is None else np.zeros(d), yshift)
    if not out:
        raise ValueError("no rows to fit")
    return out


def total(blocks: dict[int, Gram]) -> Gram:
    items = list(blocks.values())
    out = items[0]
    for g in items[1:]:
        out = out + g
    return out


def fold_column(df: DataFrame, folds: int, seed: int = 42, row_id: Sequence[str] = ()) -> Column:
    """Seeded fold number of a row, a plain expression of its id (or of the whole row)."""
    cols = [F.col(f"`{c}`") for c in (row_id or df.columns)]
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(folds)).cast("int")


def absolute_errors(df: DataFrame, features: Sequence[str], target: str, fold: Column,
                    rules: np.ndarray) -> np.ndarray:
    """Sum of |error| of many linear rules per fold: rules[c, f] = coefficients + intercept. One scan."""
    p, (c, folds, _) = len(features), rules.shape
    view = numeric_view(df, features, target, [fold.cast("int").alias("fold")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_error = np.zeros((c, folds))
        for batch in batches:
            x, y = matrix(batch, p), batch.column(p).to_numpy(zero_copy_only=False).astype(float)
            f = batch.column(p + 1).to_numpy(zero_copy_only=False)
            for k in range(folds):
                m = f == k
                if m.any():
                    yhat = x[m] @ rules[:, k, :p].T + rules[:, k, p]
                    total_error[:, k] += np.abs(y[m, None] - yhat).sum(0)
        flat = total_error.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                                         names=["k", "v"])

    rows = view.mapInArrow(score, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(c * folds)
    out[rows["k"].to_numpy()] = rows["v"].to_numpy()
    return out.reshape(c, folds)
