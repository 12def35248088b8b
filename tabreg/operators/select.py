"""Univariate feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double, q
from tabreg.roles import Roles


def f_scores(df: DataFrame, roles: Roles) -> DataFrame:
    """(feature, f_score) for every numeric feature: F = r^2 / (1 - r^2) * (n - 2), one scan."""
    names, y = list(roles.numeric), clean_double(roles.target)
    holes = F.sum(sum((clean_double(c).isNull().cast("long") for c in (*names, roles.target)), F.lit(0)))
    aggs = [F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("vy"), holes.alias("holes")]
    for i, c in enumerate(names):
        aggs += [F.covar_pop(clean_double(c), y).alias(f"c{i}"), F.var_pop(clean_double(c)).alias(f"v{i}")]
    checked = F.when(F.col("holes") == 0, F.col("n").cast("double")).otherwise(
        F.raise_error(F.lit("missing cells: impute before selecting features")).cast("double"))
    one = df.agg(*aggs).withColumn("n", checked)
    cells = []
    for i, c in enumerate(names):
        r2 = F.try_divide(F.col(f"c{i}") * F.col(f"c{i}"), F.col(f"v{i}") * F.col("vy"))
        cells.append(F.struct(F.lit(c).alias("feature"),
                              (F.try_divide(r2, 1 - r2) * (F.col("n") - 2)).alias("f_score")))
    return one.select(F.inline(F.array(*cells)))


def select_k_best(df: DataFrame, roles: Roles, k: int) -> tuple[DataFrame, Roles]:
    """Keep the k strongest features in their original order, plus categoricals and target."""
    if not 1 <= k <= len(roles.numeric):
        raise ValueError("k must lie between 1 and the number of numeric features")
    scores = {r["feature"]: r["f_score"] for r in f_scores(df, roles).collect()}
    place = {c: i for i, c in enumerate(roles.numeric)}
    ranked = sorted(scores, key=lambda c: (-(scores[c] if scores[c] is not None else -1.0), place[c]))
    best = [c for c in roles.numeric if c in ranked[:k]]
    kept = roles.with_features([c for c in roles.features if c in best or c in roles.categorical])
    wanted = dict.fromkeys((*roles.row_id, *roles.order_by, *kept.columns()))
    return df.select(*[q(c) for c in wanted]), kept
