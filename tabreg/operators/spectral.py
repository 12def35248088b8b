"""Normalised difference indices of band pairs and their correlation with a target."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabreg.functions.columns import clean_double, clean_double_sql, is_numeric, q
from tabreg.functions.distributions import correlation_p_value
from tabreg.operators.order import INDEX, with_row_index
from tabreg.roles import Roles

FEW_PAIRS = 64
SEPARATOR = "\u0001"


def index_value(a: str, b: str) -> Column:
    """(a - b) / (a + b); NULL where the sum is zero."""
    x, y = clean_double(a), clean_double(b)
    return F.try_divide(x - y, x + y)


@F.pandas_udf(T.DoubleType())
def _p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p_value(a, b) for a, b in zip(r, n)], dtype="float64")


def _few(df: DataFrame, pairs: list[tuple[str, str]], target: str) -> DataFrame:
    y = clean_double(target)
    aggs = []
    for i, (a, b) in enumerate(pairs):
        z = F.when(y.isNotNull(), index_value(a, b))
        seen = F.when(z.isNotNull(), y)
        aggs += [F.count(z).cast("double").alias(f"n{i}"), F.covar_pop(z, seen).alias(f"c{i}"),
                 F.var_pop(z).alias(f"z{i}"), F.var_pop(seen).alias(f"y{i}"), F.avg(seen).alias(f"m{i}")]
    cells = [F.struct(F.lit(a).alias("band1"), F.lit(b).alias("band2"), F.col(f"n{i}").alias("n"),
                      F.col(f"c{i}").alias("szy"), F.col(f"z{i}").alias("szz"), F.col(f"y{i}").alias("syy"), (F.col(f"m{i}") * F.col(f"m{i}")).alias("yy"))
             for i, (a, b) in enumerate(pairs)]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def _many(df: DataFrame, bands: list[str], target: str) -> DataFrame:
    """All pairs in one scan: every task folds its rows into one moment row per pair."""
    p = len(bands)
    left, right = np.triu_indices(p, 1)
    m = len(left)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((9, m))
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), float) for i in range(p)])
            y = np.asarray(batch.column(p).to_numpy(zero_copy_only=False), float)
            keep = ~np.isnan(y)
            x, y = x[keep], y[keep]
            at = 0
            for i in range(p - 1):
                with np.errstate(all="ignore"):
                    z = (x[:, i:i + 1] - x[:, i + 1:]) / (x[:, i:i + 1] + x[:, i + 1:])
                ok = np.isfinite(z)
                n = ok.sum(0).astype(float)
                safe = np.maximum(n, 1.0)
                z = np.where(ok, z, 0.0)
                yy = np.where(ok, y[:, None], 0.0)
                mz, my = z.sum(0) / safe, yy.sum(0) / safe
                dz, dy = np.where(ok, z - mz, 0.0), np.where(ok, yy - my, 0.0)
                total[:, at:at + p - 1 - i] += np.stack([
                    n, n * mz, n * my, (dz * dz).sum(0), (dy * dy).sum(0), (dz * dy).sum(0),
                    n * mz * mz, n * my * my, n * mz * my])
                at += p - 1 - i
        names = ["i", "j", "n", "sz", "sy", "vz", "vy", "vzy", "mzz", "myy", "mzy"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *map(pa.array, total)], names=names)

    schema = "i int, j int, n double, sz double, sy double, vz double, vy double, vzy double, " \
             "mzz double, myy double, mzy double"
    parts = df.selectExpr(*[f"{clean_double_sql(c)} AS x{i}" for i, c in enumerate((*bands, target))]).mapInArrow(fold, schema)
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in
                                    ("n", "sz", "sy", "vz", "vy", "vzy", "mzz", "myy", "mzy")])
    n = F.nullif(F.col("n"), F.lit(0.0))
    names = F.split(F.lit(SEPARATOR.join(bands)), SEPARATOR)
    return s.select(
        F.get(names, F.col("i")).alias("band1"),
        F.get(names, F.col("j")).alias("band2"), "n",
        ((F.col("vzy") + F.col("mzy") - F.col("sz") * F.col("sy") / n) / n).alias("szy"),
        ((F.col("vz") + F.col("mzz") - F.col("sz") * F.col("sz") / n) / n).alias("szz"),
        ((F.col("vy") + F.col("myy") - F.col("sy") * F.col("sy") / n) / n).alias("syy"),
        (F.col("sy") * F.col("sy") / n / n).alias("yy"))


def ndsi_correlations(df: DataFrame, roles: Roles) -> DataFrame:
    """Pearson r and p of every band pair's index with the target, from one scan; sorted by |r|."""
    bands = [c for c in roles.numeric if is_numeric(df.schema[c].dataType)]
    pairs = list(itertools.combinations(bands, 2))
    if not pairs:
        raise ValueError("at least two bands are needed")
    sums = _few(df, pairs, roles.target) if len(pairs) <= FEW_PAIRS else _many(df, bands, roles.target)
    # what is left of a constant by rounding, in its own units
    flat = (F.col("szz") <= 1e-24) | (F.col("syy") <= F.lit(1e-24) * F.col("yy"))
    r = F.when(~flat, F.try_divide(F.col("szy"), F.sqrt("szz") * F.sqrt("syy")))
    r = F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))
    out = sums.withColumn("Pearson_Corr", F.when(~flat, r))
    return out.select(
        F.concat_ws(",", "band1", "band2").alias("pair"), "band1", "band2", "Pearson_Corr",
        _p_value(F.col("Pearson_Corr"), F.col("n")).alias("p_value"),
        F.abs("Pearson_Corr").alias("Abs_Pearson_Corr"),
    ).orderBy(F.col("Abs_Pearson_Corr").desc_nulls_last(), "band1", "band2")


def _positions(pairs: DataFrame, side: str, numeric_order: bool) -> DataFrame:
    names = pairs.select(F.col(side).alias("name")).distinct()
    if numeric_order:
        names = names.withColumn("key", F.col("name").cast("double"))
        return with_row_index(names, ["key", "name"]).select("name", F.col(INDEX).alias("at"))
    return with_row_index(names, ["name"]).select("name", F.col(INDEX).alias("at"))


def ndsi_extrema(pairs: DataFrame, threshold: float = 0.4, max_distance: int = 10,
                 numeric_order: bool = False) -> DataFrame:
    """Local minima (listed first) and maxima of the band1 x band2 grid beyond the threshold.

    Only cells beyond the threshold look at their max_distance x max_distance neighbourhood, through
    an equi-join on the exact neighbour coordinates.
    """
    if max_distance < 1:
        raise ValueError("max_distance must be at least 1")
    cells = pairs.where(F.col("Pearson_Corr").isNotNull()).select("band1", "band2", "Pearson_Corr")
    rows = _positions(pairs, "band1", numeric_order).select(F.col("name").alias("band1"), F.col("at").alias("i"))
    cols = _positions(pairs, "band2", numeric_order).select(F.col("name").alias("band2"), F.col("at").alias("j"))
    grid = cells.join(rows, "band1").join(cols, "band2")
    low, high = -(max_distance // 2), max_distance - 1 - max_distance // 2
    offsets = F.sequence(F.lit(low), F.lit(high))
    peaks = grid.where(F.abs("Pearson_Corr") > threshold)
    reach = (peaks.withColumn("di", F.explode(offsets)).withColumn("dj", F.explode(offsets))
             .select("band1", "band2", F.col("Pearson_Corr").alias("own"), "i", "j",
                     (F.col("i") + F.col("di")).alias("ni"), (F.col("j") + F.col("dj")).alias("nj")))
    near = grid.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("Pearson_Corr").alias("r"))
    local = reach.join(near, ["ni", "nj"]).groupBy("band1", "band2", "own", "i", "j").agg(
        F.max("r").alias("top"), F.min("r").alias("bottom"))
    kind = (F.when((F.col("own") < -threshold) & (F.col("own") == F.col("bottom")), "min")
            .when((F.col("own") > threshold) & (F.col("own") == F.col("top")), "max"))
    return (local.withColumn("kind", kind).where(F.col("kind").isNotNull())
            .orderBy(F.col("kind").desc(), "i", "j")
            .select("band1", "band2", F.col("own").alias("Pearson_Corr"), "kind"))


def ndsi_apply(df: DataFrame, pairs: Sequence[tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """One index column ``a-b`` per pair beside the kept columns: a plain projection."""
    return df.select(*[q(c) for c in keep], *[index_value(a, b).alias(f"{a}-{b}") for a, b in pairs])
