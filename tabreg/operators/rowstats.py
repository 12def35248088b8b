"""Fourteen statistics per row over a wide numeric table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double_sql, is_numeric, q
from tabreg.operators.order import BUCKET, HALO, INDEX, order_buckets, with_halo
from tabreg.roles import Roles

STATISTICS = ("Mean", "Median", "Std", "Percent_Beyond_Std", "Amplitude", "Max", "Min", "Max_Slope", "MAD",
              "Percent_Close_to_Median", "Skew", "Flux_Percentile", "Weighted_Average",
              "Percent_Difference_Flux_Percentile")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _quantile(ordered: Column, p: float) -> Column:
    rank = (F.size(ordered) - 1) * F.lit(p)
    low = F.get(ordered, F.floor(rank).cast("int"))
    high = F.get(ordered, F.ceil(rank).cast("int"))
    return low + (high - low) * (rank - F.floor(rank))


def row_features(df: DataFrame, roles: Roles, cols: Sequence[str] | None = None, **options) -> DataFrame:
    """Row statistics plus categorical and target columns.

    The first thirteen are one projection without shuffle.  The last one compares a row with the row
    before it, so ``roles.order_by`` is required.
    """
    names = list(cols or [c for c in roles.numeric if is_numeric(df.schema[c].dataType)])
    weights = [float(c) for c in names]
    p = len(names)
    extra = list(dict.fromkeys((*roles.row_id, *roles.order_by, *roles.categorical, roles.target)))
    base = df.select(*[q(c) for c in extra], F.expr(f"array({', '.join(map(clean_double_sql, names))})").alias("a"))
    base = base.withColumn("v", F.array_compact("a")).withColumn("n", F.size("v").cast("double"))
    base = base.withColumn("Mean", F.try_divide(_total(F.col("v")), F.col("n"))) \
        .withColumn("s", F.array_sort("v")).withColumn("whole", F.col("n") == p)
    base = base.withColumn("d", F.transform("v", lambda x: x - F.col("Mean"))) \
        .withColumn("Median", _quantile(F.col("s"), 0.5))
    m2 = _total(F.transform("d", lambda x: x * x))
    m3 = _total(F.transform("d", lambda x: x * x * x))
    base = base.withColumn("m2", m2).withColumn("m3", m3) \
        .withColumn("Std", F.when(F.col("n") > 1, F.sqrt(F.try_divide("m2", F.col("n") - 1))))
    n = F.col("n")
    unbiased = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.try_divide(
        F.col("m3") / n, F.pow(F.col("m2") / n, F.lit(1.5)))
    flat = F.col("m2") / n < 1e-14
    deviations = F.array_sort(F.transform("v", lambda x: F.abs(x - F.col("Median"))))
    steps = F.transform(F.sequence(F.lit(1), F.lit(p - 1)),
                        lambda i: F.abs(F.get(F.col("a"), i) - F.get(F.col("a"), i - 1))) if p > 1 else None
    whole = F.col("whole")
    out = base.select(
        *[q(c) for c in extra], "Mean", "Median", "Std",
        (F.coalesce(F.size(F.filter("d", lambda x: F.abs(x) > F.col("Std"))), F.lit(0)) / F.lit(float(p)))
        .alias("Percent_Beyond_Std"),
        (F.array_max("v") - F.array_min("v")).alias("Amplitude"),
        F.array_max("v").alias("Max"), F.array_min("v").alias("Min"),
        (F.when(whole, F.array_max(steps)) if steps is not None else F.lit(None).cast("double")).alias("Max_Slope"),
        F.when(whole, _quantile(deviations, 0.5)).alias("MAD"),
        F.when(whole, F.size(F.filter("v", lambda x: F.abs(x - F.col("Median")) < F.col("Median") * 0.5))
               * 100.0 / p).otherwise(0.0).alias("Percent_Close_to_Median"),
        F.when(n < 3, F.lit(None)).when(flat, F.lit(0.0)).otherwise(unbiased).alias("Skew"),
        F.when(whole, _quantile(F.col("s"), 0.9)).alias("Flux_Percentile"),
        F.when(whole, _total(F.zip_with("a", F.expr(f"array({', '.join(f'{w!r}D' for w in weights)})"), lambda x, y: x * y))
               / F.lit(sum(weights))).alias("Weighted_Average"))
    parts = order_buckets(out, roles.order_by, min_rows=1, n=df.count(), **options)
    flux = F.col("Flux_Percentile")
    change = F.try_divide(flux, F.lag(flux, 1).over(parts.window())) - 1
    done = with_halo(parts, 1, 0).withColumn(STATISTICS[-1], F.coalesce(change, F.lit(0.0)))
    return done.where(~F.col(HALO)).drop(HALO, BUCKET, INDEX)
