"""What every regressor here offers: ``fit(df, features, target) -> Fitted``, ``Fitted.predict(df)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double_sql, q

PREDICTION = "prediction"
MAPPED_CELLS = 1 << 18  # of a mapped slice of rows, which then stays in a core's cache


def linear_expression(features: Sequence[str], coef: Sequence[float], intercept: float) -> Column:
    """intercept + sum(coef * feature), as one parsed JVM expression."""
    terms = [f"({float(b)!r}D) * {clean_double_sql(c)}" for c, b in zip(features, coef) if b != 0.0]
    return F.expr(" + ".join([f"({float(intercept)!r}D)", *terms]))


class Fitted:
    """A fitted model; subclasses add a prediction column lazily."""

    features: list[str]
    importances: dict[str, float] | None = None

    def predict(self, df: DataFrame, name: str = PREDICTION) -> DataFrame:
        raise NotImplementedError


class FittedLinear(Fitted):
    def __init__(self, features: Sequence[str], coef: Sequence[float], intercept: float, info: dict | None = None):
        self.features, self.coef, self.intercept = list(features), [float(b) for b in coef], float(intercept)
        self.info = info or {}

    def column(self) -> Column:
        return linear_expression(self.features, self.coef, self.intercept)

    def predict(self, df: DataFrame, name: str = PREDICTION) -> DataFrame:
        return df.withColumn(name, self.column())


class FittedMapped(Fitted):
    """Linear in mapped features; the map runs on Arrow batches inside the tasks."""

    def __init__(self, features: Sequence[str], mapper: Callable[[np.ndarray], np.ndarray],
                 coef: np.ndarray, intercept: float):
        self.features, self.mapper, self.coef, self.intercept = list(features), mapper, coef, float(intercept)

    def predict(self, df: DataFrame, name: str = PREDICTION) -> DataFrame:
        mapper, coef, intercept = self.mapper, self.coef, self.intercept
        step = max(256, MAPPED_CELLS // len(coef))
        along = mapper.along(coef) if hasattr(mapper, "along") else lambda x: mapper(x) @ coef

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in cols])
            return pd.Series(np.concatenate([along(x[at:at + step]) for at in range(0, len(x), step)] or [np.zeros(0)]) + intercept)

        return df.withColumn(name, score(*[F.expr(clean_double_sql(c)) for c in self.features]))


class FittedSpark(Fitted):
    """A Spark ML model behind a vector assembler."""

    def __init__(self, features: Sequence[str], model, importances: Sequence[float] | None = None):
        self.features, self.model = list(features), model
        if importances is not None:
            self.importances = dict(zip(self.features, [float(v) for v in importances]))

    def predict(self, df: DataFrame, name: str = PREDICTION) -> DataFrame:
        made = self.model.copy().setFeaturesCol("__x").setPredictionCol(name).transform(assemble(df, self.features, "__x"))
        return made.drop("__x")


def assemble(df: DataFrame, features: Sequence[str], out: str = "__x") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    if out in df.columns:
        return df
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


class Regressor:
    """Base of all regressors: keyword parameters with defaults."""

    defaults: dict = {}

    def __init__(self, **params):
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise ValueError(f"{type(self).__name__} has no parameters {sorted(unknown)}")
        self.params = {**self.defaults, **params}

    def with_params(self, **params) -> "Regressor":
        return type(self)(**{**self.params, **params})

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> Fitted:
        raise NotImplementedError


def present(df: DataFrame, target: str) -> DataFrame:
    return df.where(q(target).isNotNull())
