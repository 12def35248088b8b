"""Filling missing cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabreg.functions.columns import clean_double, is_fractional, numeric_columns, q
from tabreg.operators.clean import drop_null_columns, drop_null_rows
from tabreg.operators.quantiles import column_quantiles

METHODS = ("mean", "median", "mode", "zero", "knn", "drop_rows", "drop_cols")


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill missing cells with one value per column; whole-number columns widen when they must."""
    out = []
    for f in df.schema.fields:
        v = values.get(f.name)
        if v is None:
            out.append(q(f.name))
            continue
        cell, kind = q(f.name), f.dataType
        if is_fractional(kind):
            cell = F.when(~F.isnan(cell), cell)
        if isinstance(kind, T.IntegralType) and isinstance(v, float) and v != int(v):
            kind = T.DoubleType()
        out.append(F.coalesce(cell.cast(kind), F.lit(v).cast(kind)).alias(f.name))
    return df.select(*out)


def gap_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Numeric columns that have a missing cell."""
    if not cols:
        return []
    row = df.agg(*[F.max(clean_double(c).isNull().cast("int")).alias(f"g{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"g{i}"]]


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    if not cols:
        return {}
    row = df.agg(*[F.avg(clean_double(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def column_modes(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, object]:
    """Most frequent value per column, the smallest one on ties.

    Values of like-typed columns are stacked, counted with a map-side combine, and only the best
    (count, value) pair per column survives: no buffer ever holds a column's distinct values.
    """
    groups: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if cols is not None and f.name not in cols:
            continue
        if is_fractional(f.dataType) or isinstance(f.dataType, T.DecimalType):
            groups.setdefault("double", []).append(f.name)
        elif isinstance(f.dataType, T.IntegralType):
            groups.setdefault("long", []).append(f.name)
        elif isinstance(f.dataType, T.StringType):
            groups.setdefault("string", []).append(f.name)
        elif isinstance(f.dataType, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            groups.setdefault(f.dataType.simpleString(), []).append(f.name)
    out: dict[str, object] = {}
    for kind, names in groups.items():
        cells = [F.struct(F.lit(i).alias("i"),
                          (clean_double(c) if kind == "double" else q(c).cast(kind)).alias("v"))
                 for i, c in enumerate(names)]
        counted = (df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull())
                   .groupBy("i", "v").agg(F.count(F.lit(1)).alias("c")))
        best = counted.groupBy("i").agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("v"))).alias("b"))
        for r in best.collect():
            out[names[r["i"]]] = r["b"]["v"]
    return out


def impute(df: DataFrame, method: str, k: int = 5, row_id: Sequence[str] = (),
           cols: Sequence[str] | None = None) -> DataFrame:
    """Fill or drop missing cells by one of METHODS.  Text columns are left alone except by mode."""
    numeric = [c for c in (cols or numeric_columns(df)) if c in numeric_columns(df)]
    if method == "mean":
        return fill(df, column_means(df, gap_columns(df, numeric)))
    if method == "median":
        return fill(df, {c: v[0] for c, v in column_quantiles(df, gap_columns(df, numeric), [0.5]).items()})
    if method == "mode":
        return fill(df, column_modes(df, cols))
    if method == "zero":
        return fill(df, {c: 0 for c in numeric})
    if method == "knn":
        from tabreg.operators.neighbors import knn_impute

        return knn_impute(df, numeric, k, row_id)
    if method == "drop_rows":
        return drop_null_rows(df, cols)
    if method == "drop_cols":
        return drop_null_columns(df)
    raise ValueError(f"unknown imputation method {method!r}; choose from {METHODS}")
