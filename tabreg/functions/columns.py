"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """One marker for a missing cell: NaN becomes NULL in every float column."""
    return df.select(*[
        F.when(~F.isnan(q(f.name)), q(f.name)).alias(f.name) if is_fractional(f.dataType) else q(f.name)
        for f in df.schema.fields
    ])


def clean_double_sql(name: str) -> str:
    quoted = "`" + name.replace("`", "``") + "`"
    return f"nanvl(CAST({quoted} AS DOUBLE), CAST(NULL AS DOUBLE))"


def clean_double(name: str) -> Column:
    """A numeric cell as double, NaN read as missing (one parsed expression: wide tables build fast)."""
    return F.expr(clean_double_sql(name))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded value without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def literal(value, dtype: T.DataType) -> Column:
    return F.lit(value).cast(dtype)
