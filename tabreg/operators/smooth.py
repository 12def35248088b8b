"""Smoothing along a stated row order, over the whole table and without a single-partition stage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabreg.functions.columns import clean_double, numeric_columns, q
from tabreg.operators.order import BUCKET, HALO, INDEX, drop_halo, order_buckets, with_halo

CHUNK_ROWS = 2_000_000
METHODS = ("moving_average", "exponential", "savgol", "lowess")


def _targets(df: DataFrame, order_by: Sequence[str], cols: Sequence[str] | None) -> list[str]:
    return list(cols) if cols is not None else [c for c in numeric_columns(df) if c not in order_by]


def _replace(df: DataFrame, new: dict) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else q(c) for c in df.columns])


def moving_average(df: DataFrame, window_size: int, order_by: Sequence[str],
                   cols: Sequence[str] | None = None, **options) -> DataFrame:
    """Centred mean; NULL unless every cell of the window is present."""
    if window_size < 1:
        raise ValueError("window_size must be positive")
    after = (window_size - 1) // 2
    before = window_size - 1 - after
    parts = order_buckets(df, order_by, min_rows=window_size, **options)
    w = parts.window().rowsBetween(-before, after)
    new = {c: F.when(F.count(clean_double(c)).over(w) == window_size, F.avg(clean_double(c)).over(w))
           for c in _targets(df, order_by, cols)}
    return drop_halo(_replace(with_halo(parts, before, after), new)).select(*df.columns)


def savgol_weights(window_size: int, order: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(centre weights, full hat matrix) of a polynomial least-squares fit on an even grid."""
    x = np.arange(window_size) - window_size // 2
    basis = np.vander(x.astype(float), order + 1, increasing=True)
    inverse = np.linalg.pinv(basis)
    return inverse[0], basis @ inverse


def savitzky_golay(df: DataFrame, window_size: int, order_by: Sequence[str],
                   cols: Sequence[str] | None = None, order: int = 3, **options) -> DataFrame:
    """Cubic smoothing weights inside; the first and last half window come from one edge fit each."""
    if window_size % 2 == 0 or window_size <= order:
        raise ValueError(f"window_size must be odd and larger than {order}")
    half = window_size // 2
    centre, hat = savgol_weights(window_size, order)
    parts = order_buckets(df, order_by, min_rows=2 * window_size, **options)
    if parts.rows < window_size:
        raise ValueError("the table has fewer rows than the window")
    w = parts.window()

    def blend(c: str, weights: np.ndarray, shift: int):
        """sum of weights[j] * cell at row offset (j - shift)."""
        out = F.lit(0.0)
        for j, weight in enumerate(weights):
            cell = clean_double(c)
            d = j - shift
            if d:
                cell = F.lag(cell, -d).over(w) if d < 0 else F.lead(cell, d).over(w)
            out = out + F.lit(float(weight)) * cell
        return out

    new = {}
    for c in _targets(df, order_by, cols):
        value = F.when(F.col(INDEX).between(half, parts.rows - 1 - half), blend(c, centre, half))
        for p in range(half):
            value = value.when(F.col(INDEX) == p, blend(c, hat[p], p))
            back = window_size - 1 - p
            value = value.when(F.col(INDEX) == parts.rows - 1 - p, blend(c, hat[back], back))
        new[c] = value
    return drop_halo(_replace(with_halo(parts, window_size - 1, window_size - 1), new)).select(*df.columns)


def _decayed(values: np.ndarray, keep: float, carry: float) -> np.ndarray:
    """s[i] = keep * s[i-1] + values[i], started from ``carry``."""
    import pandas as pd

    if keep == 0.0:
        return values.copy()
    a = 1.0 - keep
    seeded = np.concatenate(([a * carry], values))
    return pd.Series(seeded).ewm(alpha=a, adjust=False).mean().to_numpy()[1:] / a


FADED = 1e-280


def _ratio(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    return np.divide(num, den, out=np.full(len(num), np.nan), where=den > FADED)


def _held(mean: np.ndarray, before: float) -> np.ndarray:
    """Where all weight has faded away, the last mean still stands."""
    at = np.maximum.accumulate(np.where(np.isnan(mean), -1, np.arange(len(mean))))
    return np.where(at >= 0, mean[np.maximum(at, 0)], before)


def _series(table: pa.Table, col: str) -> tuple[np.ndarray, np.ndarray]:
    x = table[col].cast(pa.float64()).to_numpy(zero_copy_only=False)
    seen = ~np.isnan(x)
    return np.where(seen, x, 0.0), seen


def exponential(df: DataFrame, alpha: float, order_by: Sequence[str],
                cols: Sequence[str] | None = None, **options) -> DataFrame:
    """Exponentially weighted mean of all earlier rows; a missing cell shows the last mean but ages it.

    Numerator and denominator are affine scans: every bucket first reports its own end state, the
    few end states are chained, and each bucket is then finished from its starting state.
    """
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be in (0, 1]")
    keep = 1.0 - alpha
    names = _targets(df, order_by, cols)
    parts = order_buckets(df, order_by, **options)
    placed, sizes = with_halo(parts, 0, 0).drop(HALO), list(parts.counts)
    if max(sizes) > CHUNK_ROWS:
        # a task holds one bucket as Arrow data: cut big buckets further, by position
        placed = placed.withColumn(BUCKET, F.floor(F.col(INDEX) / CHUNK_ROWS).cast("int"))
        sizes = [min(CHUNK_ROWS, parts.rows - at) for at in range(0, parts.rows, CHUNK_ROWS)]
    starts = {c: [(0.0, 0.0, np.nan)] * len(sizes) for c in names}
    if len(sizes) > 1:
        starts = _chain(_end_states(placed, names, keep), sizes, names, keep)
    fields = [T.StructField(f.name, T.DoubleType()) if f.name in names else f for f in df.schema.fields]

    def finish(key, table):
        table = table.sort_by(INDEX)
        bucket = table[BUCKET][0].as_py()
        for c in names:
            x, seen = _series(table, c)
            num0, den0, mean0 = starts[c][bucket]
            mean = _held(_ratio(_decayed(x, keep, num0), _decayed(seen.astype(float), keep, den0)), mean0)
            at = table.schema.get_field_index(c)
            table = table.set_column(at, c, pa.array(mean, from_pandas=True))
        return table.drop_columns([INDEX, BUCKET])

    out = placed.select(*[q(c) for c in df.columns], BUCKET, INDEX)
    return out.groupBy(BUCKET).applyInArrow(finish, T.StructType(fields))


def _end_states(placed: DataFrame, names: list[str], keep: float) -> DataFrame:
    schema = "bucket int, " + ", ".join(f"num{i} double, den{i} double, mean{i} double" for i in range(len(names)))

    def ends(key, table):
        table = table.sort_by(INDEX)
        row = {"bucket": pa.array([key[0].as_py()], pa.int32())}
        for i, c in enumerate(names):
            x, seen = _series(table, c)
            num, den = _decayed(x, keep, 0.0), _decayed(seen.astype(float), keep, 0.0)
            row[f"num{i}"], row[f"den{i}"] = [float(num[-1])], [float(den[-1])]
            row[f"mean{i}"] = [float(_held(_ratio(num, den), np.nan)[-1])]
        return pa.table(row)

    return placed.select(BUCKET, INDEX, *[q(c) for c in names]).groupBy(BUCKET).applyInArrow(ends, schema)


def _chain(states: DataFrame, sizes: list[int], names: list[str], keep: float) -> dict[str, list]:
    by_bucket = {r["bucket"]: r for r in states.collect()}  # one row per bucket
    out = {c: [] for c in names}
    for i, c in enumerate(names):
        num, den, mean = 0.0, 0.0, np.nan
        for b, size in enumerate(sizes):
            out[c].append((num, den, mean))
            fade, own = keep ** size, by_bucket[b]
            num, den = num * fade + own[f"num{i}"], den * fade + own[f"den{i}"]
            if den > FADED:
                mean = num / den
            elif not np.isnan(own[f"mean{i}"]):
                mean = own[f"mean{i}"]
    return out


def smooth(df: DataFrame, method: str, order_by: Sequence[str], window_size: int = 3, alpha: float = 0.3,
           cols: Sequence[str] | None = None, **options) -> DataFrame:
    if method == "moving_average":
        return moving_average(df, window_size, order_by, cols, **options)
    if method == "exponential":
        return exponential(df, alpha, order_by, cols, **options)
    if method == "savgol":
        return savitzky_golay(df, window_size, order_by, cols, **options)
    if method == "lowess":
        from tabreg.operators.lowess import lowess

        return lowess(df, window_size, order_by, cols, **options)
    raise ValueError(f"unknown smoothing method {method!r}; choose from {METHODS}")
