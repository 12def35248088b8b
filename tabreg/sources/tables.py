"""Reading tables and previewing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabreg.functions.columns import nan_to_null, q

READABLE = ("csv", "parquet")


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None,
               normalise_nan: bool = True) -> DataFrame:
    """Load a CSV (header row, inferred or given types) or parquet table.

    ``normalise_nan=False`` keeps the scan columns bare, so that later filters reach the parquet
    reader; use it where the data is known to hold no NaN.
    """
    kind = (fmt or path.rsplit(".", 1)[-1]).lower()
    if kind not in READABLE:
        raise ValueError(f"cannot read {kind!r}: convert the table to csv or parquet first")
    if kind == "csv":
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
    else:
        df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    return nan_to_null(df) if normalise_nan else df


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First rows in a stated order (a top-n, no full sort)."""
    return df.orderBy(*[q(c) for c in order_by]).limit(n)
