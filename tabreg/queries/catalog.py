"""Registry of named queries, each with the SQL that an independent engine runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabreg.functions.columns import rounded
from tabreg.sources.shipping import ship_package
from tabreg.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; these hold no NaN, so scans stay bare and filters reach the reader."""
    ship_package(spark)
    return read_table(spark, f"{sf_dir}/{name}.parquet", normalise_nan=False)


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[rounded(F.col(f"`{c}`"), digits).alias(c) if kinds[c] == "double" else F.col(f"`{c}`")
                       for c in df.columns])


def r(expression: str, digits: int = 6) -> str:
    """The same rounding on the SQL side."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"
