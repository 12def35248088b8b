"""Scores of a prediction column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double


def score_columns(y: Column, yhat: Column) -> dict[str, Column]:
    """MAE, MSE, RMSE, R2 and RPD (sample deviation of y over RMSE) as aggregate columns."""
    both = y.isNotNull() & yhat.isNotNull()
    y, err = F.when(both, y), F.when(both, y - yhat)
    mse = F.avg(err * err)
    spread = F.var_pop(y)
    return {"mae": F.avg(F.abs(err)), "mse": mse, "rmse": F.sqrt(mse),
            "r2": 1 - F.try_divide(mse, spread),
            "rpd": F.try_divide(F.stddev_samp(y), F.sqrt(mse))}


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    made = score_columns(clean_double(y), clean_double(yhat))
    return df.agg(*[c.alias(name) for name, c in made.items()])


def true_vs_predicted(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.select(clean_double(y).alias("y"), clean_double(yhat).alias("yhat"))


def identity_line(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """End points of the 1:1 line of a true-versus-predicted chart."""
    return df.agg(F.least(F.min(clean_double(y)), F.min(clean_double(yhat))).alias("low"),
                  F.greatest(F.max(clean_double(y)), F.max(clean_double(yhat))).alias("high"))
