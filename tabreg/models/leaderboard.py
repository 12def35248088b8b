"""Many models with default settings on one prepared table, ranked."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double, is_numeric, q
from tabreg.models.base import Fitted
from tabreg.models.registry import REGRESSORS, make
from tabreg.operators.encode import OneHot, Scaler, fit_one_hot, fit_scaler, ordinal_encode
from tabreg.operators.evaluate import score_columns
from tabreg.operators.impute import column_means, fill
from tabreg.operators.profile import cardinality_split
from tabreg.roles import Roles

MISSING = "missing"
HIGH_CARDINALITY = 11


@dataclass
class Preprocessor:
    """Fitted on train rows: mean-impute and standardise numbers, one-hot few values, ordinal codes for many."""

    numeric: list[str]
    low: list[str]
    high: list[str]
    means: dict[str, float | None]
    scaler: Scaler
    dummies: OneHot
    train: DataFrame
    handle_unknown: str

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *[n for c in self.low for n in self.dummies.names(c)], *self.high]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        texts = [*self.low, *self.high]
        view = df.select(*[q(c) for c in dict.fromkeys((*keep, *self.numeric, *texts))])
        view = fill(view, {**self.means, **{c: MISSING for c in texts}})
        view = self.dummies.transform(self.scaler.transform(view))
        if self.high:
            seen = fill(self.train.select(*[q(c) for c in self.high]), {c: MISSING for c in self.high})
            view = ordinal_encode(seen, view, self.high, self.handle_unknown)
        return view


def fit_preprocessor(train: DataFrame, roles: Roles, handle_unknown: str = "error") -> Preprocessor:
    kinds = {f.name: f.dataType for f in train.schema.fields}
    numeric = [c for c in roles.features if is_numeric(kinds[c])]
    texts = [c for c in roles.features if kinds[c].typeName() == "string"]
    low, high = cardinality_split(train, texts, HIGH_CARDINALITY)
    means = column_means(train, numeric)
    filled = fill(train.select(*[q(c) for c in (*numeric, *low)]), {**means, **{c: MISSING for c in low}})
    return Preprocessor(numeric, low, high, means, fit_scaler(filled, numeric, "standard"),
                        fit_one_hot(filled, low), train, handle_unknown)


@dataclass
class Leaderboard:
    scores: DataFrame
    fitted: dict[str, Fitted]
    prepared: Preprocessor
    test: DataFrame
    target: str
    times: dict[str, float] = field(default_factory=dict)

    def predictions(self, row_id: Sequence[str]) -> DataFrame:
        """Row id, truth and one column per fitted model."""
        out = self.test
        for name, model in self.fitted.items():
            out = model.predict(out, name)
        return out.select(*[q(c) for c in row_id], q(self.target), *[q(n) for n in self.fitted])

    def release(self) -> None:
        """Drop the cached test rows once predictions are written."""
        self.test.unpersist()

    def best(self, k: int = 15) -> list[str]:
        rows = self.scores.where(F.col("status") == "ok").orderBy(F.col("r_squared").desc_nulls_last(), "model").limit(k)
        return [r["model"] for r in rows.collect()]


def adjusted(r2: float | None, n: int, p: int) -> float | None:
    """1 - (1 - R2)(n - 1)/(n - p - 1), with the test size and the raw column count."""
    return None if r2 is None or n - p - 1 <= 0 else 1.0 - (1.0 - r2) * (n - 1) / (n - p - 1)


def leaderboard(train: DataFrame, test: DataFrame, roles: Roles, models: Sequence[str] | str = "all",
                custom_metric: Callable[[Column, Column], Column] | None = None, parallelism: int = 4,
                handle_unknown: str = "error", settings: dict[str, dict] | None = None,
                fitted: dict[str, Fitted] | None = None) -> Leaderboard:
    """Fit every named model; a failing one is reported and skipped.  ``fitted`` models are reused as they are."""
    names = list(REGRESSORS) if models == "all" else list(models)
    prep = fit_preprocessor(train, roles, handle_unknown)
    keep = list(dict.fromkeys((*roles.row_id, roles.target)))
    xtrain = prep.transform(train, keep).persist(StorageLevel.MEMORY_AND_DISK)
    xtest = prep.transform(test, keep).persist(StorageLevel.MEMORY_AND_DISK)
    n_test, p, cache = xtest.count(), len(roles.features), dict(fitted or {})
    y = clean_double(roles.target)

    def one(name: str):
        start = time.perf_counter()
        try:
            model = cache.get(name) or make(name, **(settings or {}).get(name, {})).fit(xtrain, prep.features, roles.target)
            cols = score_columns(y, F.col("__yhat"))
            aggs = [cols["r2"].alias("r2"), cols["rmse"].alias("rmse")]
            if custom_metric is not None:
                aggs.append(custom_metric(y, F.col("__yhat")).cast("double").alias("custom"))
            r = model.predict(xtest, "__yhat").agg(*aggs).first()
            row = (name, adjusted(r["r2"], n_test, p), r["r2"], r["rmse"], time.perf_counter() - start,
                   r["custom"] if custom_metric is not None else None, "ok", None)
            return model, row
        except Exception as e:  # noqa: BLE001  one model's failure must not stop the others
            return None, (name, None, None, None, time.perf_counter() - start, None, "failed",
                          f"{type(e).__name__}: {str(e)[:300]}")

    try:
        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            done = list(pool.map(one, names))
    finally:
        xtrain.unpersist()
    scores = train.sparkSession.createDataFrame(
        [row for _, row in done], "model string, adjusted_r_squared double, r_squared double, rmse double, "
                                  "time_taken double, custom_metric double, status string, error string")
    scores = scores.orderBy(F.col("adjusted_r_squared").desc_nulls_last(), "model")
    good = {name: m for name, (m, _) in zip(names, done) if m is not None}
    return Leaderboard(scores, good, prep, xtest, roles.target, {row[0]: row[4] for _, row in done})
