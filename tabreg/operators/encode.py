"""Scaling and categorical encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double_sql, q
from tabreg.operators.order import INDEX, with_row_index

MAX_DUMMIES = 10_000
SMALL_CODE_TABLE = 100_000
HOT_SHARE = 1_000
SALTS = 4_096


@dataclass(frozen=True)
class Scaler:
    """(x - shift) / width per column; a column without spread maps to 0."""

    shift: dict[str, float]
    width: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.apply(c).alias(c) if c in self.shift else q(c) for c in df.columns])

    def apply(self, c: str) -> Column:
        x = clean_double_sql(c)
        if not self.width[c]:
            return F.expr(f"CASE WHEN {x} IS NOT NULL THEN 0.0D END")
        return F.expr(f"({x} - ({float(self.shift[c])!r}D)) / ({float(self.width[c])!r}D)")


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "standard") -> Scaler:
    """One aggregate over all columns.  'standard' uses the population deviation, 'minmax' the range."""
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown scaler {kind!r}")
    if not cols:
        return Scaler({}, {})
    row = df.agg(*[F.expr(f"{fn}({clean_double_sql(c)}) AS {name}{i}") for i, c in enumerate(cols)
                   for fn, name in (("min", "lo"), ("max", "hi"), ("avg", "m"), ("stddev_pop", "s"))]).first()
    shift, width = {}, {}
    for i, c in enumerate(cols):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        spread = 0.0 if lo is None or lo == hi else (row[f"s{i}"] if kind == "standard" else hi - lo)
        shift[c] = (row[f"m{i}"] if kind == "standard" else lo) or 0.0
        width[c] = spread
    return Scaler(shift, width)


def scale(df: DataFrame, cols: Sequence[str], kind: str = "standard", fit_on: DataFrame | None = None) -> DataFrame:
    """Scale ``cols``; statistics come from all rows, or from ``fit_on`` (e.g. the train rows)."""
    return fit_scaler(df if fit_on is None else fit_on, cols, kind).transform(df)


def categories(df: DataFrame, col: str, limit: int = MAX_DUMMIES) -> list[str]:
    """Sorted distinct values; refuses a column with more than ``limit`` of them."""
    rows = df.where(q(col).isNotNull()).groupBy(q(col)).count().select(q(col)).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col!r} has more than {limit} values; use sparse_dummies, or pass a larger limit")
    return sorted(r[0] for r in rows)


@dataclass(frozen=True)
class OneHot:
    levels: dict[str, tuple]

    def names(self, c: str) -> list[str]:
        return [f"{c}_{v}" for v in self.levels[c]]

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [q(c) for c in df.columns if c not in self.levels]
        made = [F.coalesce((q(c) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}")
                for c, vs in self.levels.items() for v in vs]
        return df.select(*kept, *made)


def fit_one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = False, limit: int = MAX_DUMMIES) -> OneHot:
    return OneHot({c: tuple(categories(df, c, limit)[1 if drop_first else 0:]) for c in cols})


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = False, limit: int = MAX_DUMMIES) -> DataFrame:
    """0/1 columns ``{column}_{value}`` in sorted value order; NULL gives all zeros.

    A table has one column per value here: beyond ``limit`` values of a column use ``sparse.sparse_dummies``."""
    return fit_one_hot(df, cols, drop_first, limit).transform(df)


def code_table(df: DataFrame, col: str) -> DataFrame:
    """(value, code, rows): codes 0.. in sorted order of the distinct values."""
    counted = (df.where(q(col).isNotNull()).groupBy(q(col).alias("value"))
               .agg(F.count(F.lit(1)).alias("rows")))
    return with_row_index(counted, ["value"]).select("value", F.col(INDEX).alias("code"), "rows")


def attach_codes(df: DataFrame, col: str, codes: DataFrame, name: str, total: int, size: int) -> DataFrame:
    """Look codes up.  A small table is broadcast.  Beyond that, the at most HOT_SHARE values that own
    more than 1/HOT_SHARE of the rows are broadcast, and only the remaining rows are shuffled."""
    if size <= SMALL_CODE_TABLE:
        small = F.broadcast(codes.select(F.col("value").alias("__v"), F.col("code").alias(name)))
        return df.join(small, q(col) == F.col("__v"), "left").drop("__v")
    hot = codes.where(F.col("rows") * HOT_SHARE > total)
    near = F.broadcast(hot.select(F.col("value").alias("__v"), F.col("code").alias("__hot")))
    marked = df.join(near, q(col) == F.col("__v"), "left").drop("__v")
    settled = F.col("__hot").isNotNull() | q(col).isNull()
    spread = F.pmod(F.xxhash64(*[q(c) for c in df.columns]), F.lit(SALTS)).cast("int")
    marked = marked.withColumn("__salt", F.when(settled, spread).otherwise(F.lit(-1)))
    cold = codes.where(F.col("rows") * HOT_SHARE <= total).select(
        F.col("value").alias("__v"), F.col("code").alias("__cold"), F.lit(-1).alias("__s"))
    joined = marked.join(cold, (F.col("__salt") == F.col("__s")) & (q(col) == F.col("__v")), "left")
    return joined.withColumn(name, F.coalesce("__hot", "__cold")).drop("__hot", "__cold", "__v", "__s", "__salt")


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each text column by its sorted-order code; NULL stays NULL."""
    order = df.columns
    for c in cols:
        codes = code_table(df, c)
        sizes = df.where(q(c).isNotNull()).agg(F.count(F.lit(1)), F.count_distinct(q(c))).first()
        df = attach_codes(df, c, codes, "__code", sizes[0], sizes[1]).drop(c).withColumnRenamed("__code", c)
    return df.select(*[q(c) for c in order])


def ordinal_encode(train: DataFrame, df: DataFrame, cols: Sequence[str], handle_unknown: str = "error") -> DataFrame:
    """Codes learnt on ``train``; an unseen value is an error, or -1 with handle_unknown='keep'."""
    if handle_unknown not in ("error", "keep"):
        raise ValueError("handle_unknown must be 'error' or 'keep'")
    order = df.columns
    for c in cols:
        codes = code_table(train, c)
        sizes = train.where(q(c).isNotNull()).agg(F.count(F.lit(1)), F.count_distinct(q(c))).first()
        df = attach_codes(df, c, codes, "__code", sizes[0], sizes[1])
        unseen = q(c).isNotNull() & F.col("__code").isNull()
        fallback = (F.lit(-1).cast("long") if handle_unknown == "keep" else
                    F.raise_error(F.concat(F.lit(f"unknown value in {c}: "), q(c))).cast("long"))
        df = df.withColumn("__code", F.when(unseen, fallback).otherwise(F.col("__code")))
        df = df.drop(c).withColumnRenamed("__code", c)
    return df.select(*[q(c) for c in order])
