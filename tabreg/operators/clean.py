"""Row and cell cleaning: sentinels, ranges, outliers, missing rows and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabreg.functions.columns import is_fractional, is_numeric, q
from tabreg.operators.order import INDEX, with_row_index
from tabreg.operators.profile import _missing
from tabreg.operators.quantiles import column_quantiles


def drop_first_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """Drop the first ``n`` rows in the stated order; ``INDEX`` of the result starts at 0."""
    rows = df.count()
    if not 1 <= n <= rows - 1:
        raise ValueError(f"n must lie between 1 and {rows - 1}")
    indexed = with_row_index(df, order_by, n=rows)
    return indexed.where(F.col(INDEX) >= n).withColumn(INDEX, F.col(INDEX) - n)


def _as_number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _matches(col: Column, dtype: T.DataType, values: Sequence) -> Column | None:
    """Whole-cell match, by the column's own type."""
    texts = [str(v) for v in values]
    numbers = [x for x in map(_as_number, texts) if x is not None and x == x]
    if is_numeric(dtype) and numbers:
        return col.cast("double").isin(*numbers)
    if isinstance(dtype, T.StringType):
        return col.isin(*texts)
    return None


def replace_with_null(df: DataFrame, values) -> DataFrame:
    """Turn cells equal to a value (or to one of a comma-separated list) into NULL, in every column."""
    if isinstance(values, str):
        values = [v.strip() for v in values.split(",")]
    elif not isinstance(values, (list, tuple, set)):
        values = [values]
    out = []
    for f in df.schema.fields:
        hit = _matches(q(f.name), f.dataType, list(values))
        out.append(q(f.name) if hit is None else F.when(~hit, q(f.name)).alias(f.name))
    return df.select(*out)


def _coerced(df: DataFrame, name: str) -> Column | None:
    dtype = df.schema[name].dataType
    if is_numeric(dtype):
        return q(name).cast("double")
    if isinstance(dtype, T.StringType):
        return q(name).try_cast("double")
    return None


def _in_range(df: DataFrame, name: str, lo: float, hi: float) -> Column:
    x = _coerced(df, name)
    return F.lit(False) if x is None else F.coalesce(x.between(lo, hi), F.lit(False))


def replace_range_with_null(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """Cells whose numeric reading lies in [lo, hi] become NULL; text is read through a safe cast."""
    return df.select(*[F.when(~_in_range(df, c, lo, hi), q(c)).alias(c) for c in df.columns])


def range_report(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """Per column: cells replaced by the range rule and whether any cell is numeric at all."""
    exprs = []
    for i, c in enumerate(df.columns):
        x = _coerced(df, c)
        exprs.append(F.coalesce(F.sum(_in_range(df, c, lo, hi).cast("long")), F.lit(0)).alias(f"r{i}"))
        exprs.append((F.lit(0) if x is None else F.count(F.when(~F.isnan(x), x))).cast("long").alias(f"n{i}"))
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("replaced"),
                      (F.col(f"n{i}") > 0).alias("checked")) for i, c in enumerate(df.columns)]
    return df.agg(*exprs).select(F.inline(F.array(*cells)))


def remove_outliers_iqr(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Interquartile filter, column after column: each one sees the rows the earlier ones left.

    The quartiles are exact; they enter the plan as literals, so the result is one filtered scan.
    """
    if not 1.0 <= multiplier <= 3.0:
        raise ValueError("multiplier must be between 1 and 3")
    for c in cols:
        if c not in df.columns or not is_numeric(df.schema[c].dataType):
            continue
        q1, q3 = column_quantiles(df, [c], [0.25, 0.75])[c]
        if q1 is None:
            return df.where(F.lit(False))
        reach = multiplier * (q3 - q1)
        df = df.where((q(c) >= F.lit(q1 - reach)) & (q(c) <= F.lit(q3 + reach)))
    return df


def remove_by_threshold(df: DataFrame, col: str, condition: str, threshold: float | None = None,
                        low: float | None = None, high: float | None = None) -> DataFrame:
    """Remove rows beyond a limit; a missing cell never passes."""
    if col not in df.columns:
        return df
    x = q(col)
    if condition == "greater than" and threshold is not None:
        keep = x <= threshold
    elif condition == "less than" and threshold is not None:
        keep = x >= threshold
    elif condition == "outside range" and low is not None and high is not None:
        keep = (x >= low) & (x <= high)
    else:
        return df
    if is_fractional(df.schema[col].dataType):
        keep = keep & ~F.isnan(x)  # NaN sorts above every number
    return df.where(keep)


def removal_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts before and after, and the removed share in percent."""
    a = before.agg(F.count(F.lit(1)).alias("rows_before"))
    b = after.agg(F.count(F.lit(1)).alias("rows_after"))
    removed = F.col("rows_before") - F.col("rows_after")
    return (a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")
            .withColumn("removed", removed)
            .withColumn("removed_percent", F.try_divide(removed * 100.0, F.col("rows_before"))))


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(cols) if cols else None)


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Remove every column that has a missing cell (one aggregate decides)."""
    row = df.agg(*[F.max(_missing(df, c).cast("int")).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[q(c) for i, c in enumerate(df.columns) if not row[f"m{i}"]])
