"""Robust local linear smoothing (Cleveland 1979) over row positions, exact at any size.

Rows are dealt by position into chunks of ``CHUNK`` rows.  Every chunk meets each output chunk that its rows can reach (as many as
the window spans), and each such pair adds up five weighted sums per output position in one task; Spark sums the parts.  So a task
holds one chunk, however wide the window or long the table, and every row takes part in its own k nearest rows' fits only.  Each
robust round writes position, value and fit to the shared folder and frees the one before.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double, numeric_columns, q
from tabreg.operators.order import INDEX, with_row_index
from tabreg.operators.quantiles import column_quantiles
from tabreg.sources.storage import cut_lineage, discard

CHUNK = 20_000


def tricube(u: np.ndarray) -> np.ndarray:
    u = np.abs(u)
    return np.where(u > 0.999, 0.0, np.where(u < 0.001, 1.0, (1.0 - np.minimum(u, 1.0) ** 3) ** 3))


def neighbourhoods(at: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, radius) of the k nearest positions on an even grid."""
    left = np.clip(np.ceil(at - k / 2), 0, n - k).astype(np.int64)
    right = left + k - 1
    return left, right, np.maximum(at - left, right - at).astype(float)


def local_sums(pos: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, n: int, k: int) -> np.ndarray:
    """Five sums for each position ``at`` over the sorted rows ``pos``, distances in units of the radius."""
    out = np.zeros((5, len(at)))
    left, right, radius = neighbourhoods(at, n, k)
    width = max(16, min(k // 2, 2_000_000 // min(len(pos), 2 * k)))
    for start in range(0, len(at), width):
        block = slice(start, start + width)
        lo, hi = np.searchsorted(pos, left[block][0]), np.searchsorted(pos, right[block][-1], side="right")
        if lo == hi:
            continue
        p, z = pos[lo:hi], y[lo:hi]
        d = (p[None] - at[block, None]) / np.maximum(radius[block, None], 1e-300)
        weight = tricube(d) * w[None, lo:hi]
        weight[(p[None] < left[block, None]) | (p[None] > right[block, None])] = 0.0
        wd = weight * d
        out[:, block] = [weight.sum(1), wd.sum(1), (wd * d).sum(1), weight @ z, wd @ z]
    return out


def lowess(df: DataFrame, k: int, order_by: Sequence[str], cols: Sequence[str] | None = None,
           robust_rounds: int = 3, chunk: int = CHUNK, **options) -> DataFrame:
    """Smooth with the k nearest rows.  A missing cell takes no part and stays missing; positions are
    counted over the present rows.  Where every neighbour has lost its weight, the value itself stays."""
    names = list(cols) if cols is not None else [c for c in numeric_columns(df) if c not in order_by]
    out = cut_lineage(with_row_index(df, order_by, "__row", **options))
    for c in names:
        made = _smooth_one(out.select("__row", clean_double(c).alias("y")).where(F.col("y").isNotNull()),
                           k, robust_rounds, chunk, options)
        out = out.join(made, "__row", "left").withColumn(c, F.col("__fit")).drop("__fit")
    return out.select(*[q(c) for c in df.columns])


def _smooth_one(rows: DataFrame, k: int, robust_rounds: int, chunk: int, options: dict) -> DataFrame:
    rows = cut_lineage(with_row_index(rows, ["__row"], **options).withColumn("w", F.lit(1.0)))
    n = rows.count()
    if n < 3:
        return rows.select("__row", F.col("y").alias("__fit"))
    k = max(2, min(int(k), n))
    last = (n - 1) // chunk

    def add_up(key: tuple, group: pa.Table) -> pa.Table:
        own, other = int(key[0].as_py()), int(key[1].as_py())
        order = np.argsort(group.column(INDEX).to_numpy())
        pos, y, w = (group.column(c).to_numpy()[order].astype(float) for c in (INDEX, "y", "w"))
        low, high = max(own * chunk, int(pos[0]) - k), min((own + 1) * chunk, n, int(pos[-1]) + k + 1)
        at = np.arange(low, max(low, high), dtype=float)
        sums = local_sums(pos, y, w, at, n, k) if len(at) else np.zeros((5, 0))
        hit = np.flatnonzero(sums[0]) if own != other else np.arange(len(at))
        return pa.table({"at": pa.array(at[hit].astype(np.int64)),
                         **{c: pa.array(s[hit]) for c, s in zip(("s0", "s1", "s2", "t0", "t1"), sums)}})

    for r in range(robust_rounds + 1):
        other = F.floor(F.col(INDEX) / chunk).cast("long")
        reach = F.explode(F.sequence(F.greatest(F.floor((F.col(INDEX) - k) / chunk), F.lit(0)).cast("long"),
                                     F.least(F.floor((F.col(INDEX) + k) / chunk), F.lit(last)).cast("long")))
        sums = (rows.select(INDEX, "y", "w", other.alias("other"), reach.alias("own")).groupBy("own", "other")
                .applyInArrow(add_up, "at long, s0 double, s1 double, s2 double, t0 double, t1 double")
                .groupBy("at").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "s2", "t0", "t1")]))
        det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
        line = (F.when(F.col("s0") <= 0, F.col("y"))
                .when(det > 1e-12 * F.col("s0") * F.col("s0"), (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det)
                .otherwise(F.col("t0") / F.col("s0")))
        fitted = cut_lineage(rows.drop("w").join(sums, F.col(INDEX) == F.col("at"))
                             .select("__row", INDEX, "y", line.alias("__fit")))
        discard(rows)
        rows = fitted
        if r == robust_rounds:
            break
        spread = rows.select(F.abs(F.col("y") - F.col("__fit")).alias("e"))
        cut = 6.0 * column_quantiles(spread, ["e"], [0.5])["e"][0]
        if cut == 0.0:
            break
        u = F.abs(F.col("y") - F.col("__fit")) / cut
        rows = rows.withColumn("w", F.when(u > 0.999, 0.0).when(u < 0.001, 1.0).otherwise(F.pow(1 - u * u, 2)))
    return rows.select("__row", "__fit")
