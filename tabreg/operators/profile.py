"""Profiling: shape, missing cells, kinds, cardinality, basic statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double, is_fractional, is_numeric, numeric_columns, q
from tabreg.operators.quantiles import column_quantiles


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"))


def _missing(df: DataFrame, name: str):
    c = q(name)
    return c.isNull() | F.isnan(c) if is_fractional(df.schema[name].dataType) else c.isNull()


def null_counts(df: DataFrame, total_name: str | None = "__total__") -> DataFrame:
    """Missing cells per column, plus a grand-total row, from one aggregate."""
    flags = [F.coalesce(F.sum(_missing(df, c).cast("long")), F.lit(0)).alias(c) for c in df.columns]
    one = df.agg(*flags)
    cells = [F.struct(F.lit(c).alias("column"), q(c).alias("nulls")) for c in df.columns]
    if total_name is not None:
        total = sum((q(c) for c in df.columns), F.lit(0).cast("long"))
        cells.append(F.struct(F.lit(total_name).alias("column"), total.alias("nulls")))
    return one.select(F.inline(F.array(*cells)))


def column_kinds(df: DataFrame) -> dict[str, list[str]]:
    """Names split by type, from the schema alone."""
    numeric = numeric_columns(df)
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    other = [c for c in df.columns if c not in numeric and c not in text]
    return {"numeric": numeric, "text": text, "other": other}


def cardinality(df: DataFrame, cols: Sequence[str], n: int = 11, approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column and whether they are more than ``n``."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    one = df.agg(*[count(q(c)).alias(c) for c in cols])
    cells = [F.struct(F.lit(c).alias("column"), q(c).alias("distinct_values"),
                      F.when(q(c) > n, "high").otherwise("low").alias("cardinality")) for c in cols]
    return one.select(F.inline(F.array(*cells)))


def cardinality_split(df: DataFrame, cols: Sequence[str], n: int = 11,
                      approximate: bool = False) -> tuple[list[str], list[str]]:
    """(low, high) column names; high means more than ``n`` distinct values."""
    if not cols:
        return [], []
    kinds = {r["column"]: r["cardinality"] for r in cardinality(df, cols, n, approximate).collect()}
    return [c for c in cols if kinds[c] == "low"], [c for c in cols if kinds[c] == "high"]


def threshold_defaults(df: DataFrame, col: str) -> DataFrame:
    """Median, 5 % and 95 % quantile: the suggested limits for threshold filters."""
    q05, med, q95 = column_quantiles(df, [col], [0.05, 0.5, 0.95])[col]
    return df.sparkSession.createDataFrame(
        [(col, med, q05, q95)], "column string, median double, q05 double, q95 double")


def basic_statistics(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of numeric columns."""
    cols = list(cols or numeric_columns(df))
    bad = [c for c in cols if not is_numeric(df.schema[c].dataType)]
    if bad:
        raise ValueError(f"not numeric: {bad}")
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(clean_double(c)).alias(f"n{i}"), F.avg(clean_double(c)).alias(f"m{i}"),
        F.stddev_samp(clean_double(c)).alias(f"s{i}"), F.min(clean_double(c)).alias(f"l{i}"),
        F.max(clean_double(c)).alias(f"h{i}"))]).first()
    quart = column_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"l{i}"], *quart[c], row[f"h{i}"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, "
              "q25 double, q50 double, q75 double, max double")
