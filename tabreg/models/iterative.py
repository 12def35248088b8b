"""Regressors with one Spark job per round, robust fits, mapped features and target transforms."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double, clean_double_sql, q
from tabreg.models.base import Fitted, FittedLinear, FittedMapped, Regressor
from tabreg.models.gram import column_shift, grams, matrix, numeric_view, total
from tabreg.models.linear import LinearRegression, least_squares
from tabreg.operators.encode import fit_scaler
from tabreg.operators.quantiles import column_quantiles
from tabreg.sources.storage import cut_lineage, discard, spread


def _slope(loss: str, e: np.ndarray, eps: float) -> np.ndarray:
    """Derivative of the loss in the prediction, at error e = prediction - y."""
    if loss == "squared_error":
        return e
    if loss == "huber":
        return np.clip(e, -eps, eps)
    if loss == "epsilon_insensitive":
        return np.sign(e) * (np.abs(e) > eps)
    if loss == "squared_epsilon_insensitive":
        return 2 * np.sign(e) * np.maximum(np.abs(e) - eps, 0.0)
    raise ValueError(f"unknown loss {loss!r}")


def _cost(loss: str, e: np.ndarray, eps: float) -> np.ndarray:
    a = np.abs(e)
    if loss == "squared_error":
        return 0.5 * e * e
    if loss == "huber":
        return np.where(a <= eps, 0.5 * e * e, eps * a - 0.5 * eps * eps)
    if loss == "epsilon_insensitive":
        return np.maximum(a - eps, 0.0)
    return np.maximum(a - eps, 0.0) ** 2


WALK_ROWS = 4_096


def walks(df: DataFrame, features: Sequence[str], target: str, seed: int) -> tuple[DataFrame, float]:
    """Different rows with their counts, dealt by a keyed hash to walks of about ``WALK_ROWS`` rows (one row per walk, arrays in the order
    of the hashes), written once; and the number of rows. Neither depends on the layout of the table."""
    view = numeric_view(df, features, target)
    columns = view.columns
    rows = view.groupBy(*[q(c) for c in columns]).agg(F.count(F.lit(1)).cast("double").alias("__n")).withColumn(
        "__k", F.xxhash64(F.lit(seed), *[q(c) for c in columns]))
    rows = cut_lineage(rows)
    size = rows.agg(F.count(F.lit(1)), F.sum("__n")).first()
    walk = F.pmod(F.xxhash64("__k"), F.lit(max(1, -(-size[0] // WALK_ROWS)))).alias("walk")
    row = F.struct("__k", *[q(c).alias(f"c{i}") for i, c in enumerate(columns)], "__n")
    held = rows.groupBy(walk).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    out = cut_lineage(held.select(*[F.col("rows").getField(c).alias(c) for c in (*(f"c{i}" for i in range(len(columns))), "__n")]))
    discard(rows)
    return out, float(size[1] or 0)


def descend(df: DataFrame, features, target: str, *, loss: str, penalty: str | None = "l2", alpha: float = 1e-4,
            l1_ratio: float = 0.15, eps: float = 0.1, rounds: int = 40, tol: float = 1e-4,
            patience: int = 5, step: float = 1.0, power: float = 0.5, batch_rows: int = 32,
            fit_intercept: bool = True, passive: float | None = None, seed: int = 42):
    """Mini-batch descent with parameter averaging (Zinkevich et al. 2010): (coefficients, intercept).

    Rows are dealt to walks by hash. In each round every walk goes through its own rows from the shared start and reports one vector;
    the row-weighted mean starts the next round, so the result depends on the rows and the seed only.  Features enter in standard
    units, and so does the target, so step sizes need no tuning.  With ``passive`` (C) a batch takes the mean of its rows' closed-form
    passive-aggressive steps (Crammer et al. 2006) instead of a gradient step; later rounds average, with weight 1 / sqrt(round).
    """
    p = len(features)
    scaler = fit_scaler(df, [*features, target], "standard")
    mean = np.array([scaler.shift[c] for c in features])
    wide = np.array([scaler.width[c] or 1.0 for c in features])
    ymean, ywide = scaler.shift[target], scaler.width[target] or 1.0
    view, n = walks(df, features, target, seed)
    if not n:
        raise ValueError("no rows to fit")
    d = p
    w = np.zeros(d + 1)
    l1 = alpha * {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio}[penalty] if penalty else 0.0
    l2 = alpha * {"l2": 1.0, "l1": 0.0, "elasticnet": 1 - l1_ratio}[penalty] if penalty else 0.0
    best, best_cost, stale = w.copy(), np.inf, 0
    for r in range(rounds):
        rate, start = step / (1.0 + r) ** power, w.copy()

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    held = [batch.column(i)[k].values.to_numpy(zero_copy_only=False).astype(float) for i in range(p + 2)]
                    x, y, times = (np.column_stack(held[:p]) - mean) / wide, (held[p] - ymean) / ywide, held[p + 1]
                    cost, own = (times * _cost(loss, x @ start[:d] + start[d] - y, eps)).sum(), start.copy()
                    for at in range(0, len(y), batch_rows):
                        xb, yb, tb = x[at:at + batch_rows], y[at:at + batch_rows], times[at:at + batch_rows]
                        share, error = tb / tb.sum(), xb @ own[:d] + own[d] - yb
                        if passive is not None:
                            norm, left = (xb * xb).sum(1) + fit_intercept, np.maximum(np.abs(error) - eps, 0.0)
                            tau = np.minimum(passive, left / np.maximum(norm, 1e-12)) if loss == "epsilon_insensitive" else left / (norm + 0.5 / passive)
                            slope, move = np.sign(error) * tau * share, 1.0
                        else:
                            slope, move = _slope(loss, error, eps) * share, rate / max(1.0, share @ (xb * xb).sum(1))
                        own[:d] -= move * (xb.T @ slope + (l2 * own[:d] if passive is None else 0.0))
                        if l1 and passive is None:
                            own[:d] = np.sign(own[:d]) * np.maximum(np.abs(own[:d]) - move * l1, 0.0)
                        if fit_intercept:
                            own[d] -= move * slope.sum()
                    row = np.concatenate([own * times.sum(), [times.sum(), cost]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], names=["k", "v"])

        got = view.mapInArrow(walk, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        v = np.zeros(d + 3)
        v[got["k"].to_numpy()] = got["v"].to_numpy()
        cost = v[d + 2] / v[d + 1] + (0.5 * l2 * start[:d] @ start[:d] + l1 * np.abs(start[:d]).sum() if passive is None else 0.0)
        if cost < best_cost - tol * max(abs(best_cost), 1e-12) if np.isfinite(best_cost) else True:
            best, best_cost, stale = start, cost, 0
        else:
            stale += 1
            if cost < best_cost:
                best, best_cost = start, cost
        if stale >= patience:
            break
        w = v[:d + 1] / v[d + 1]
        if passive is not None and r:
            w = start + (w - start) / np.sqrt(r + 1)
    discard(view)
    coef = best[:d] / wide * ywide
    return coef, best[d] * ywide + ymean - coef @ mean


class PassiveAggressive(Regressor):
    """Averaged passive-aggressive regression, in standard units; ``C`` bounds a step."""

    defaults = {"C": 1.0, "epsilon": 0.1, "loss": "epsilon_insensitive", "fit_intercept": True, "max_iter": 40, "tol": 1e-3,
                "n_iter_no_change": 5, "random_state": 42}

    def fit(self, df, features, target):
        o = self.params
        if o["loss"] not in ("epsilon_insensitive", "squared_epsilon_insensitive"):
            raise ValueError("loss must be epsilon_insensitive or squared_epsilon_insensitive")
        coef, b = descend(df, features, target, loss=o["loss"], penalty=None, eps=float(o["epsilon"]), rounds=int(o["max_iter"]), tol=float(o["tol"]),
                          patience=int(o["n_iter_no_change"]), fit_intercept=bool(o["fit_intercept"]), passive=float(o["C"]),
                          seed=int(o["random_state"] or 42))
        return FittedLinear(features, coef, b)


class SGD(Regressor):
    defaults = {"loss": "squared_error", "penalty": "l2", "alpha": 1e-4, "l1_ratio": 0.15, "epsilon": 0.1,
                "max_iter": 40, "tol": 1e-4, "eta0": 1.0, "power_t": 0.5, "fit_intercept": True,
                "n_iter_no_change": 5, "random_state": 42}

    def fit(self, df, features, target):
        o = self.params
        loss = "squared_error" if o["loss"] == "squared_loss" else o["loss"]
        coef, b = descend(df, features, target, loss=loss, penalty=o["penalty"], alpha=o["alpha"],
                          l1_ratio=o["l1_ratio"], eps=o["epsilon"], rounds=int(o["max_iter"]),
                          tol=o["tol"], step=o["eta0"], power=o["power_t"], fit_intercept=o["fit_intercept"],
                          patience=int(o["n_iter_no_change"]), seed=int(o["random_state"] or 42))
        return FittedLinear(features, coef, b)


def reweighted(df: DataFrame, features, target: str, *, eps: float = 0.0, tau: float = 0.5, strength: float = 0.0,
               rounds: int = 30, tol: float = 1e-4, fit_intercept: bool = True, mapper: Callable | None = None):
    """Absolute-type losses by reweighted least squares (Perez-Cruz et al. 2000): one scan per round.

    Minimises strength * |b|^2 / 2 + sum of losses, where an error beyond eps costs its excess, times
    2 tau below and 2 (1 - tau) above the rule.  Every round replaces the loss by a parabola that
    touches it at the current errors, so the objective never rises.
    """
    df = cut_lineage(spread(df.select(*[F.expr(f"{clean_double_sql(c)} AS `{c}`") for c in (*features, target)])))
    centre = column_shift(df, features, target)
    g = total(grams(df, features, target, mapper=mapper, centre=centre))
    unit = np.sqrt(max(g.variance, 1e-300))

    def solve(g):
        c, v, _ = g.moments(fit_intercept)
        coef = (np.linalg.solve(c + np.eye(len(v)) * strength / g.n, v) if strength > 0 else least_squares(c, v))
        return coef, g.intercept(coef, fit_intercept)

    coef, b = solve(g)
    for r in range(rounds):
        floor = unit * max(1e-4, 0.03 * 0.4 ** r)

        def adjust(x, y, coef=coef, b=b, floor=floor):
            e = y - x @ coef - b
            excess = np.abs(e) - eps
            side = np.where(e > 0, 2 * tau, 2 * (1 - tau))
            if eps == 0.0:
                return side / np.maximum(excess, floor), y
            return np.where(excess > 0, side / np.maximum(excess, floor), 0.0), y - eps * np.sign(e)

        g = total(grams(df, features, target, mapper=mapper, adjust=adjust, centre=centre))
        if g.n <= 0:  # every row lies inside the tube
            break
        old, shift = coef, b
        coef, b = solve(g)
        step = coef - old
        c, _, _ = g.moments(True)
        moved = np.sqrt(max(step @ c @ step, 0.0)) + abs(b - shift + (g.xmean @ step))
        if moved <= tol * unit and floor <= unit * 1e-4:
            break
    discard(df)
    return coef, b


class Quantile(Regressor):
    """Linear quantile regression (pinball loss)."""

    defaults = {"quantile": 0.5, "max_iter": 40, "fit_intercept": True}

    def fit(self, df, features, target):
        o = self.params
        return FittedLinear(features, *reweighted(df, features, target, tau=o["quantile"], rounds=int(o["max_iter"]),
                                                  fit_intercept=o["fit_intercept"]))


@dataclass
class FourierMap:
    """Random Fourier features of a Gaussian kernel (Rahimi & Recht 2007) in standard units."""

    mean: np.ndarray
    wide: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.phases)) * np.cos(((x - self.mean) / self.wide) @ self.directions + self.phases)


def scaled_fourier(mean: np.ndarray, wide: np.ndarray, gamma: float, count: int, seed: int) -> FourierMap:
    rng = np.random.default_rng(seed)
    directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (len(mean), count))
    return FourierMap(mean, wide, directions, rng.uniform(0.0, 2 * np.pi, count))


def _units(df: DataFrame, features) -> tuple[np.ndarray, np.ndarray]:
    s = fit_scaler(df, list(features), "standard")
    return np.array([s.shift[c] for c in features]), np.array([s.width[c] or 1.0 for c in features])


UNLIMITED = 1_000  # rounds of a fit whose caller sets no limit; it stops by its tolerance


class SupportVector(Regressor):
    """epsilon-insensitive regression.  kernel 'linear' solves the linear machine; 'rbf' uses random
    features and is an approximation of the kernel machine, declared as such."""

    defaults = {"C": 1.0, "epsilon": 0.1, "kernel": "linear", "gamma": "scale", "components": 100, "max_iter": 30,
                "tol": 1e-4, "random_state": 42}

    def fit(self, df, features, target):
        o = self.params
        rounds = int(o["max_iter"]) if o["max_iter"] > 0 else UNLIMITED
        options = dict(eps=o["epsilon"], strength=1.0 / o["C"], rounds=rounds, tol=o["tol"])
        if o["kernel"] == "linear":
            return FittedLinear(features, *reweighted(df, features, target, **options))
        if o["kernel"] != "rbf":
            raise ValueError("kernel must be linear or rbf")
        mean, wide = _units(df, features)
        gamma = o["gamma"] if isinstance(o["gamma"], float) else 1.0 / len(features)
        mapper = scaled_fourier(mean, wide, gamma, o["components"], o["random_state"])
        return FittedMapped(features, mapper, *reweighted(df, features, target, mapper=mapper, **options))


class LinearSupportVector(SupportVector):
    defaults = {**SupportVector.defaults, "epsilon": 0.0}


class RadialSupportVector(SupportVector):
    defaults = {**SupportVector.defaults, "kernel": "rbf"}


class NuSupportVector(SupportVector):
    """Support vector regression whose tube leaves about the share ``nu`` of the rows outside: fits alternate with the quantile of
    the absolute errors that the next tube takes, until its width settles."""

    defaults = {**{k: v for k, v in SupportVector.defaults.items() if k != "epsilon"}, "kernel": "rbf", "nu": 0.5}
    turns, settled = 6, 0.02

    def fit(self, df, features, target):
        share = 1.0 - min(max(float(self.params["nu"]), 1e-6), 1.0)
        centre = column_quantiles(df, [target], [0.5])[target][0]
        off = df.select(F.abs(clean_double(target) - F.lit(centre)).alias("e"))
        width = column_quantiles(off, ["e"], [share])["e"][0]
        inner = {k: v for k, v in self.params.items() if k != "nu"}
        for _ in range(self.turns):
            model = SupportVector(**inner, epsilon=float(width)).fit(df, features, target)
            off = model.predict(df, "__fit").select(F.abs(clean_double(target) - F.col("__fit")).alias("e"))
            before, width = width, column_quantiles(off, ["e"], [share])["e"][0]
            if abs(width - before) <= self.settled * max(before, 1e-300):
                break
        model.info = {"epsilon": float(before)}
        return model


def unit_keys(keys: np.ndarray, trial: int) -> np.ndarray:
    """The rows' keys as numbers from 0 to 1, mixed in the trial's own way."""
    mixed = (keys ^ np.uint64((trial + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(11)) / 2.0 ** 53


class Ransac(Regressor):
    """Random sample consensus.  One job draws all trial samples, one scan counts every trial's inliers.

    Every trial draws its own rows by a hash of the row (equal rows are counted together first), so draws depend neither on other
    trials nor on the file layout, and all ``max_trials`` trials run.  Samples too large to fetch differ only in that a row joins with chance m/n."""

    defaults = {"min_samples": None, "residual_threshold": None, "max_trials": 100, "loss": "absolute_error",
                "random_state": 42}
    max_drawn = 200_000

    @staticmethod
    def _small_samples(keyed, p, m, trials, n):
        """For every trial the m different rows with the smallest keys, mixed anew for each trial: independent draws, whatever the
        layout.  A row that occurs c times gets the smallest of c keys."""

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = [(np.empty(0), np.empty((0, p + 1)))] * trials
            for batch in batches:
                z = np.column_stack([matrix(batch, p), batch.column(p).to_numpy(zero_copy_only=False).astype(float)])
                k = batch.column(p + 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                copies = batch.column(p + 2).to_numpy(zero_copy_only=False).astype(float)
                for t in range(trials):
                    mixed = -np.expm1(np.log1p(-unit_keys(k, t)) / copies)
                    first = np.argpartition(mixed, m - 1)[:m] if len(mixed) > m else np.arange(len(mixed))
                    keys, rows = np.r_[kept[t][0], mixed[first]], np.r_[kept[t][1], z[first]]
                    order = np.argsort(keys, kind="stable")[:m]
                    kept[t] = keys[order], rows[order]
            for t, (keys, rows) in enumerate(kept):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys),
                                                  pa.array(list(rows), pa.list_(pa.float64()))], names=["t", "k", "row"])

        def solve(group: pa.Table) -> pa.Table:
            rows = np.array(group.column("row").to_pylist()).reshape(-1, p + 1)
            part = rows[np.lexsort([*rows.T[::-1], group.column("k").to_numpy()])[:m]]
            rule = np.linalg.lstsq(np.column_stack([part[:, :p], np.ones(len(part))]), part[:, p], rcond=None)[0]
            return pa.table({"t": pa.array([group.column("t")[0].as_py()], pa.int32()), "rule": pa.array([rule.tolist()], pa.list_(pa.float64()))})

        drawn = keyed.mapInArrow(draw, "t int, k double, row array<double>").groupBy("t").applyInArrow(solve, "t int, rule array<double>")
        return [np.array(r["rule"]) for r in drawn.orderBy("t").collect()]

    @staticmethod
    def _large_samples(keyed, p, m, trials, n):
        """Samples too large to fetch: each row joins each trial with chance m/n, by a mixed key, and
        one scan sums the normal equations of every trial."""
        share = min(m / n, 1.0)
        d = (p + 2) * (p + 2)

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((trials, d))
            for batch in batches:
                z = np.column_stack([matrix(batch, p), np.ones(batch.num_rows),
                                     batch.column(p).to_numpy(zero_copy_only=False).astype(float)])
                k = batch.column(p + 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                copies = batch.column(p + 2).to_numpy(zero_copy_only=False).astype(float)
                for t in range(trials):
                    times = np.floor(copies * share + unit_keys(k, t))
                    part = z[times > 0]
                    sums[t] += ((part * times[times > 0, None]).T @ part).ravel()
            flat = sums.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                                             names=["k", "v"])

        got = keyed.mapInArrow(fold, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        sums = np.zeros(trials * d)
        sums[got["k"].to_numpy()] = got["v"].to_numpy()
        out = []
        for block in sums.reshape(trials, p + 2, p + 2):
            if block[p, p] > p:
                out.append(least_squares(block[:p + 1, :p + 1], block[:p + 1, p + 1]))
        return out

    def fit(self, df, features, target):
        o, p = self.params, len(features)
        n = df.count()
        size = o["min_samples"]
        m = p + 1 if size is None else (max(p + 1, int(np.ceil(size * n))) if size < 1 else int(size))
        trials = int(o["max_trials"])
        m = max(p + 1, min(m, n))
        limit = o["residual_threshold"]
        if limit is None:
            mid = column_quantiles(df, [target], [0.5])[target][0]
            off = df.select(F.abs(clean_double(target) - F.lit(mid)).alias("d"))
            limit = column_quantiles(off, ["d"], [0.5])["d"][0]
        view = numeric_view(df, features, target)
        key = F.xxhash64(F.lit(int(o["random_state"])), *[F.col(c) for c in view.columns])
        names = view.columns
        keyed = view.groupBy(*names).agg(F.count(F.lit(1)).alias("copies")).select(*names, key.alias("k"), "copies")
        rules = (self._small_samples if m * trials <= self.max_drawn else self._large_samples)(keyed, p, m, trials, n)
        if not rules:
            raise ValueError("not enough rows for one trial")
        rules = np.array(rules)
        squared = o["loss"] in ("squared_error", "squared_loss")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits, cost = np.zeros(len(rules)), np.zeros(len(rules))
            for batch in batches:
                x, y = matrix(batch, p), batch.column(p).to_numpy(zero_copy_only=False).astype(float)
                e = np.abs(y[:, None] - x @ rules[:, :p].T - rules[:, p])
                e = e * e if squared else e
                inside = e <= limit
                hits += inside.sum(0)
                cost += np.where(inside, e, 0.0).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rules), dtype=np.int32)), pa.array(hits),
                                              pa.array(cost)], names=["t", "hits", "cost"])

        counted = (view.mapInArrow(count, "t int, hits double, cost double")
                   .groupBy("t").agg(F.sum("hits").alias("hits"), F.sum("cost").alias("cost")))
        best = counted.orderBy(F.col("hits").desc(), "cost", "t").first()
        if not best["hits"]:
            raise ValueError("no trial has an inlier")
        rule = FittedLinear(features, rules[best["t"], :p], rules[best["t"], p])
        error = F.abs(clean_double(target) - rule.column())
        inliers = df.where((error * error if squared else error) <= F.lit(float(limit)))
        done = LinearRegression().fit(inliers, features, target)
        done.info = {"inliers": int(best["hits"]), "threshold": float(limit), "trials": len(rules)}
        return done


class Dummy(Regressor):
    defaults = {"strategy": "mean", "constant": None, "quantile": None}

    def fit(self, df, features, target):
        o = self.params
        if o["strategy"] == "mean":
            value = df.agg(F.avg(clean_double(target))).first()[0]
        elif o["strategy"] == "constant":
            value = o["constant"]
        elif o["strategy"] in ("median", "quantile"):
            share = 0.5 if o["strategy"] == "median" else o["quantile"]
            value = column_quantiles(df, [target], [share])[target][0]
        else:
            raise ValueError(f"unknown strategy {o['strategy']!r}")
        return FittedLinear(features, [0.0] * len(features), value)


# --- target transforms ---------------------------------------------------------------------------

def yeo_johnson(y: str, lam: float) -> str:
    up = f"log1p({y})" if abs(lam) < 1e-12 else f"(power({y} + 1, {lam!r}D) - 1) / ({lam!r}D)"
    k = 2 - lam
    down = f"-log1p(-({y}))" if abs(k) < 1e-12 else f"-(power(1 - ({y}), {k!r}D) - 1) / ({k!r}D)"
    return f"CASE WHEN {y} >= 0 THEN {up} ELSE {down} END"


def yeo_johnson_back(z: Column, lam: float) -> Column:
    up = F.expm1(z) if abs(lam) < 1e-12 else F.pow(F.greatest(z * lam + 1, F.lit(0.0)), F.lit(1 / lam)) - 1
    down = (1 - F.exp(-z)) if abs(lam - 2) < 1e-12 else 1 - F.pow(
        F.greatest(1 - (2 - lam) * z, F.lit(0.0)), F.lit(1 / (2 - lam)))
    return F.when(z >= 0, up).otherwise(down)


def box_cox(y: str, lam: float) -> str:
    return f"ln({y})" if abs(lam) < 1e-12 else f"(power({y}, {lam!r}D) - 1) / ({lam!r}D)"


def box_cox_back(z: Column, lam: float) -> Column:
    return F.exp(z) if abs(lam) < 1e-12 else F.pow(F.greatest(z * lam + 1, F.lit(0.0)), F.lit(1 / lam))


def power_lambda(df: DataFrame, target: str, kind: str) -> float:
    """Most likely power: a few scans over a shrinking grid, each scoring every candidate at once."""
    view = df.select(clean_double(target).alias("y")).where(F.col("y").isNotNull())
    yeo = kind == "yeo-johnson"
    low, high = -2.0, 4.0
    for _ in range(4):
        grid = np.linspace(low, high, 13)

        def moments(batches: Iterator[pa.RecordBatch], grid=grid) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                if not len(y):
                    continue
                logs = np.sign(y) * np.log1p(np.abs(y)) if yeo else np.log(y)
                size = np.abs(logs)
                out = []
                for g in grid:
                    e = np.where(y < 0, 2 - g, g) if yeo else np.full(len(y), g)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        z = np.where(np.abs(e) < 1e-12, size if yeo else logs, np.expm1(e * (size if yeo else logs)) / e)
                    z = np.where(y < 0, -z, z) if yeo else z
                    out.append((z.mean(), ((z - z.mean()) ** 2).sum()))
                mean, rest = np.array(out).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(grid), dtype=np.int32)), pa.array(np.full(len(grid), float(len(y)))),
                     pa.array(mean * len(y)), pa.array(rest + len(y) * mean * mean),
                     pa.array(np.full(len(grid), logs.sum()))], names=["k", "n", "s", "ss", "logs"])

        rows = (view.mapInArrow(moments, "k int, n double, s double, ss double, logs double")
                .groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "logs")]).orderBy("k").collect())
        scores = []
        for g, r in zip(grid, rows):
            variance = r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2
            scores.append(-r["n"] / 2 * np.log(variance) + (g - 1) * r["logs"] if variance > 0 else -np.inf)
        best = int(np.argmax(scores))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    return float(grid[best])


@dataclass
class Back:
    """From the transformed target to the target."""

    kind: str
    power: float = 0.0
    values: Sequence[float] = ()
    places: Sequence[float] = ()

    def __call__(self, z: Column) -> Column:
        if self.kind == "log":
            return F.exp(z)
        if self.kind == "quantile":
            places, values = np.array(self.places), np.array(self.values)

            @F.pandas_udf("double")
            def value(s: pd.Series) -> pd.Series:
                return pd.Series(np.interp(s.to_numpy(float), places, values))

            return value(z)
        return yeo_johnson_back(z, self.power) if self.kind == "yeo-johnson" else box_cox_back(z, self.power)


class FittedBack(Fitted):
    def __init__(self, inner: Fitted, back: Back):
        self.inner, self.features, self.back = inner, inner.features, back

    def predict(self, df, name="prediction"):
        return self.inner.predict(df, name).withColumn(name, self.back(q(name)))


class TransformedTarget(Regressor):
    """Transform the target, fit, and transform predictions back."""

    defaults = {"regressor": None, "transformer": None, "n_quantiles": 1000}

    def fit(self, df, features, target):
        inner = self.params["regressor"] or LinearRegression()
        kind = self.params["transformer"]
        if kind is None:
            return inner.fit(df, features, target)
        y = clean_double(target)
        if kind in ("box-cox", "log") and df.where(y <= 0).limit(1).count():
            raise ValueError(f"{kind} needs a positive target")
        if kind == "log":
            made, back = F.log(y), Back(kind)
        elif kind in ("yeo-johnson", "box-cox"):
            lam = power_lambda(df, target, kind)
            made = F.expr((yeo_johnson if kind == "yeo-johnson" else box_cox)(f"({clean_double_sql(target)})", lam))
            back = Back(kind, lam)
        elif kind == "quantile":
            marks = np.linspace(0.0, 1.0, int(self.params["n_quantiles"]))
            found = df.agg(F.percentile_approx(y, F.array(*[F.lit(float(m)) for m in marks]), 100_000)).first()[0]
            values, first = np.unique(np.array(found), return_index=True)
            places = marks[first]

            @F.pandas_udf("double")
            def rank(s: pd.Series) -> pd.Series:
                return pd.Series(np.interp(s.to_numpy(float), values, places))

            made, back = rank(y), Back(kind, values=values.tolist(), places=places.tolist())
        else:
            raise ValueError(f"unknown transformer {kind!r}")
        view = df.select(*[F.expr(f"{clean_double_sql(c)} AS `{c}`") for c in features], made.alias("__t"))
        return FittedBack(inner.fit(view, features, "__t"), back)


