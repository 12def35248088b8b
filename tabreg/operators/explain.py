"""Importances, partial dependence and additive attributions of a fitted model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import regression as M
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double, clean_double_sql, q
from tabreg.models.base import Fitted, FittedLinear, FittedSpark
from tabreg.models.trees import FittedTrees, attributions, trees_of_spark
from tabreg.operators.evaluate import score_columns
from tabreg.operators.order import INDEX
from tabreg.operators.permute import from_blocks, permuted_position, random_blocks, shuffler
from tabreg.operators.quantiles import column_quantiles
from tabreg.operators.split import shuffle
from tabreg.sources.storage import cut_lineage, discard

SPARK_TREES = (M.DecisionTreeRegressionModel, M.RandomForestRegressionModel, M.GBTRegressionModel)


def _ranked(df: DataFrame, values: dict[str, float]) -> DataFrame:
    order = sorted(values, key=lambda c: (-values[c], c))
    return df.sparkSession.createDataFrame([(c, float(values[c]), i + 1) for i, c in enumerate(order)],
                                           "feature string, importance double, rank int")


def feature_importance(model: Fitted, df: DataFrame, target: str, row_id: Sequence[str], n_repeats: int = 10,
                       seed: int = 42) -> DataFrame:
    """The model's own importances, or permutation importances where it has none; best first."""
    if model.importances is not None:
        return _ranked(df, model.importances)
    return permutation_importance(model, df, target, row_id, n_repeats, seed)


def _positioned(df: DataFrame, features: Sequence[str], row_id: Sequence[str], seed: int, extra=()) -> tuple[DataFrame, int]:
    """INDEX (a random but repeatable position), row id as __id0.., extras, features as doubles; written once."""
    base = shuffle(df.select(*[q(c) for c in dict.fromkeys((*row_id, *features))], *extra), row_id, seed)
    rows = cut_lineage(base.select(
        INDEX, *[q(c).alias(f"__id{i}") for i, c in enumerate(row_id)],
        *[F.col(c) for c in base.columns if c == "__y"],
        *[F.expr(f"{clean_double_sql(c)} AS `{c}`") for c in features]))
    return rows, rows.count()


def permutation_importance(model: Fitted, df: DataFrame, target: str, row_id: Sequence[str], n_repeats: int = 10,
                           seed: int = 42) -> DataFrame:
    """Mean drop of R2 when one feature is shuffled.

    Rows are written once in random blocks; inside a block every feature of every repeat is shuffled in its own way, without a join.
    All features of a repeat are scored by one aggregate.
    """
    features = list(model.features)
    rows, _ = _positioned(df, features, row_id, seed, [clean_double(target).alias("__y")])
    base = model.predict(rows, "__yhat").agg(score_columns(F.col("__y"), F.col("__yhat"))["r2"]).first()[0]
    blocks = random_blocks(rows, [*features, "__y"])
    discard(rows)
    totals = np.zeros(len(features))
    schema = ", ".join(["__f int", "__y double", *(f"`{c}` double" for c in features)])
    for r in range(n_repeats):
        def make(block: int, held: list[np.ndarray], r=r):
            n = len(held[-1])
            for k in range(len(features)):
                moved = [h[shuffler(seed, r, block, k).permutation(n)] if i == k else h for i, h in enumerate(held[:-1])]
                yield [np.full(n, k, np.int32), held[-1], *moved]

        scored = model.predict(from_blocks(blocks, [*features, "__y"], schema, make), "__yhat").groupBy("__f").agg(
            score_columns(F.col("__y"), F.col("__yhat"))["r2"].alias("r2")).collect()
        for s in scored:
            totals[s["__f"]] += base - s["r2"]
    discard(blocks)
    return _ranked(df, dict(zip(features, totals / n_repeats)))


def dependence_grid(df: DataFrame, feature: str, points: int = 100) -> list[float]:
    """The distinct values if there are few, else an even grid between the 5 % and 95 % quantiles."""
    few = df.where(clean_double(feature).isNotNull()).select(clean_double(feature).alias("v")).distinct().limit(points).collect()
    if len(few) < points:
        return sorted(r["v"] for r in few)
    low, high = column_quantiles(df, [feature], [0.05, 0.95])[feature]
    return [float(v) for v in np.linspace(low, high, points)]


def partial_dependence(model: Fitted, df: DataFrame, feature: str, points: int = 100) -> DataFrame:
    """(value, average): mean prediction with the feature fixed at each grid value."""
    grid = dependence_grid(df, feature, points)
    spark = df.sparkSession
    if isinstance(model, FittedLinear):  # the average of a linear rule needs only column means
        at = model.features.index(feature)
        mean = df.agg(F.avg(model.column()).alias("p"), F.avg(clean_double(feature)).alias("m")).first()
        rows = [(v, mean["p"] + model.coef[at] * (v - mean["m"])) for v in grid]
        return spark.createDataFrame(rows, "value double, average double")
    view = df.select(*[F.expr(f"{clean_double_sql(c)} AS `{c}`") for c in model.features if c != feature],
                     F.explode(F.expr(f"array({', '.join(f'{v!r}D' for v in grid)})")).alias(feature))
    return (model.predict(view, "__yhat").groupBy(q(feature).alias("value")).agg(F.avg("__yhat").alias("average"))
            .orderBy("value"))


def shap_values(model: Fitted, df: DataFrame, row_id: Sequence[str], n_permutations: int = 10, seed: int = 42) -> DataFrame:
    """Row id, one attribution column per feature, and ``base_value``; they add up to the prediction.
    A row-id column that is also a feature is returned as ``{name}_id``.

    Linear models: coefficient times distance from the mean, exact.  Trees, forests and boosted trees: exact Shapley
    values of the trees, features outside a subset being averaged by the nodes' shares of the training rows (Lundberg
    et al. 2020); of models with a log link, those of the logarithm.  Other models: sampled permutation values (Strumbelj & Kononenko 2014).  Each sample walks from a random background row to the row,
    one feature at a time; the steps live inside the row, and one aggregate per row adds them up.
    """
    features = list(model.features)
    if isinstance(model, FittedLinear):
        ids = [q(c).alias(c if c not in features else f"{c}_id") for c in row_id]
        row = df.agg(*[F.avg(clean_double(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
        parts = [(F.lit(b) * (clean_double(c) - F.lit(row[f"m{i}"]))).alias(c)
                 for i, (c, b) in enumerate(zip(features, model.coef))]
        base = model.intercept + sum(b * row[f"m{i}"] for i, b in enumerate(model.coef))
        return df.select(*ids, *parts, F.lit(float(base)).alias("base_value"))
    if isinstance(model, FittedTrees) or isinstance(model, FittedSpark) and isinstance(model.model, SPARK_TREES):
        trees = model if isinstance(model, FittedTrees) else trees_of_spark(model.model, df.sparkSession, features)
        return attributions(trees, df, [q(c).alias(c if c not in features else f"{c}_id") for c in row_id])
    p = len(features)
    rows, n = _positioned(df, features, row_id, seed)
    donor = rows.select(F.col(INDEX).alias("__to"), F.array(*[q(c) for c in features]).alias("__z"))
    walks = None
    for r in range(n_permutations):
        paired = rows.withColumn("__to", permuted_position(F.col(INDEX), n, seed + r)).join(donor, "__to")
        order = F.array_sort(F.array(*[F.struct(F.xxhash64(F.col(INDEX), F.lit(r * p + i)).alias("h"), F.lit(i).alias("i"))
                                       for i in range(p)]))
        one = paired.withColumn("__order", F.transform(order, lambda s: s["i"]))
        walks = one if walks is None else walks.unionByName(one)
    steps = walks.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(p))))
    keys = [f"__id{i}" for i in range(len(row_id))]
    mixed = steps.select(*keys, "__s", "__order", *[
        F.when(F.array_position("__order", F.lit(i)) <= F.col("__s"), q(c)).otherwise(F.col("__z")[i]).alias(c)
        for i, c in enumerate(features)])
    scored = model.predict(mixed, "__yhat")
    gained, lost = F.get(F.col("__order"), F.col("__s") - 1), F.get(F.col("__order"), F.col("__s"))
    signed = [F.when(gained == i, F.col("__yhat")).when(lost == i, -F.col("__yhat")).otherwise(F.lit(0.0))
              for i in range(p)]
    summed = (scored.groupBy(*keys).agg(
        *[(F.sum(s) / n_permutations).alias(c) for s, c in zip(signed, features)],
        (F.sum(F.when(F.col("__s") == 0, F.col("__yhat")).otherwise(0.0)) / n_permutations).alias("base_value")))
    return summed.select(*[F.col(k).alias(c) if c not in features else F.col(k).alias(f"{c}_id")
                           for k, c in zip(keys, row_id)], *[q(c) for c in features], "base_value")


def shap_summary(values: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, max_abs, mean_abs), largest maximum first."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(q(c)).alias("v")) for c in features])
    return (values.select(F.inline(cells)).groupBy("feature")
            .agg(F.max("v").alias("max_abs"), F.avg("v").alias("mean_abs"))
            .orderBy(F.col("max_abs").desc(), "feature"))
