"""Seeded random search over parameter spaces, with k-fold scores."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double, clean_double_sql
from tabreg.models.base import Fitted, Regressor
from tabreg.models.gram import absolute_errors, fold_column, grams, total
from tabreg.models.linear import GramRegressor
from tabreg.operators.evaluate import score_columns

SCORINGS = ("r2", "neg_mean_absolute_error", "neg_mean_squared_error", "neg_root_mean_squared_error")


@dataclass(frozen=True)
class RandInt:
    low: int
    high: int  # exclusive

    def draw(self, rng: random.Random):
        return rng.randrange(self.low, self.high)


@dataclass(frozen=True)
class Uniform:
    """Spans [low, low + width]."""

    low: float
    width: float

    def draw(self, rng: random.Random):
        return self.low + self.width * rng.random()


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def draw(self, rng: random.Random):
        return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))


def draw(space: dict, n_iter: int, seed: int) -> list[dict]:
    """Distinct parameter settings; a small finite space is listed once."""
    rng, out, seen = random.Random(seed), [], set()
    for _ in range(n_iter * 20):
        pick = {k: (v.draw(rng) if hasattr(v, "draw") else rng.choice(list(v))) for k, v in space.items()}
        tag = repr(sorted(pick.items(), key=lambda kv: kv[0]))
        if tag not in seen:
            seen.add(tag)
            out.append(pick)
        if len(out) == n_iter:
            break
    return out


@dataclass
class SearchResult:
    model: Fitted
    params: dict
    score: float
    seconds: float
    status: str
    trials: list[tuple[dict, float]]


def _score(scoring: str, mse: float, mae: float, variance: float) -> float:
    if scoring == "r2":
        return 1.0 - mse / variance if variance > 0 else float("nan")
    return {"neg_mean_absolute_error": -mae, "neg_mean_squared_error": -mse,
            "neg_root_mean_squared_error": -math.sqrt(mse)}[scoring]


def _gram_scores(reg: GramRegressor, df: DataFrame, features, target, settings, folds, seed, scoring):
    fold = fold_column(df, folds, seed)
    blocks = grams(df, features, target, fold)
    whole = total(blocks)
    ids = sorted(blocks)
    rules = np.full((len(settings), folds, len(features) + 1), np.nan)
    scores = np.full((len(settings), len(ids)), np.nan)
    for i, params in enumerate(settings):
        model = reg.with_params(**params)
        for j, f in enumerate(ids):
            rest = {k: g for k, g in blocks.items() if k != f}
            try:
                coef, intercept, _ = model.solve(whole - blocks[f], rest)
            except (np.linalg.LinAlgError, ValueError):
                continue
            rules[i, f] = [*coef, intercept]
            if scoring != "neg_mean_absolute_error":
                scores[i, j] = _score(scoring, blocks[f].mse(np.asarray(coef), intercept), 0.0, blocks[f].variance)
    if scoring == "neg_mean_absolute_error":
        errors = absolute_errors(df, features, target, fold, np.nan_to_num(rules))
        for j, f in enumerate(ids):
            scores[:, j] = np.where(np.isnan(rules[:, f, 0]), np.nan, -errors[:, f] / blocks[f].n)
    return scores.mean(axis=1)


def _fold_scores(reg: Regressor, df: DataFrame, features, target, settings, folds, seed, scoring, parallelism):
    view = df.select(*[F.expr(f"{clean_double_sql(c)} AS `{c}`") for c in features],
                     clean_double(target).alias(target), fold_column(df, folds, seed).alias("__fold"))
    view = view.persist(StorageLevel.MEMORY_AND_DISK)

    def one(job):
        params, f = job
        try:
            model = reg.with_params(**params).fit(view.where(F.col("__fold") != f).drop("__fold"), features, target)
            made = model.predict(view.where(F.col("__fold") == f).drop("__fold"), "__yhat")
            cols = score_columns(clean_double(target), F.col("__yhat"))
            r = made.agg(cols["r2"].alias("r2"), cols["mse"].alias("mse"), cols["mae"].alias("mae")).first()
            return r["r2"] if scoring == "r2" else _score(scoring, r["mse"], r["mae"], 1.0)
        except Exception:  # noqa: BLE001  a failing candidate scores NaN and cannot win
            return float("nan")

    try:
        jobs = [(params, f) for params in settings for f in range(folds)]
        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            got = list(pool.map(one, jobs))
    finally:
        view.unpersist()
    return np.array([np.nan if s is None else s for s in got], float).reshape(len(settings), folds).mean(axis=1)


def random_search(reg: Regressor, df: DataFrame, features: Sequence[str], target: str, space: dict, *,
                  n_iter: int = 50, folds: int = 5, seed: int = 42, scoring: str = "r2", custom: dict | None = None,
                  parallelism: int = 4) -> SearchResult:
    """Best of ``n_iter`` drawn settings by mean fold score, refitted on all rows.

    Least-squares models read the data once for all settings and folds (per-fold Gram blocks add up).
    If no setting works, the defaults are fitted and the status says so.
    """
    if scoring not in SCORINGS:
        raise ValueError(f"scoring must be one of {SCORINGS}")
    if not 2 <= folds <= 10:
        raise ValueError("folds must be between 2 and 10")
    start = time.perf_counter()
    settings = draw({**space, **(custom or {})}, n_iter, seed)
    features = list(features)
    try:
        if isinstance(reg, GramRegressor):
            scores = _gram_scores(reg, df, features, target, settings, folds, seed, scoring)
        else:
            scores = _fold_scores(reg, df, features, target, settings, folds, seed, scoring, parallelism)
    except Exception:  # noqa: BLE001
        scores = np.full(len(settings), np.nan)
    if len(scores) and not np.isnan(scores).all():
        best = int(np.nanargmax(scores))
        params, score, status = settings[best], float(scores[best]), "tuned"
    else:
        params, score, status = {}, float("nan"), "default"
    model = reg.with_params(**params).fit(df, features, target)
    return SearchResult(model, params, score, time.perf_counter() - start, status,
                        list(zip(settings, map(float, scores))))
