"""Linear regressors that need only a Gram block: the data is read once, whatever the parameters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.models.base import Fitted, FittedLinear, Regressor
from tabreg.models.gram import Gram, fold_column, grams, matrix, numeric_view, total


class GramRegressor(Regressor):
    """Subclasses turn one Gram block into (coefficients, intercept, info)."""

    inner_folds = 0

    def solve(self, g: Gram, folds: dict[int, Gram] | None = None) -> tuple[np.ndarray, float, dict]:
        raise NotImplementedError

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> Fitted:
        k = int(self.params.get("cv", self.inner_folds) or 0) if self.inner_folds else 0
        blocks = grams(df, features, target, fold_column(df, k) if k else None)
        return self.from_blocks(blocks, features)

    def from_blocks(self, blocks: dict[int, Gram], features: Sequence[str]) -> FittedLinear:
        coef, intercept, info = self.solve(total(blocks), blocks if self.inner_folds else None)
        return FittedLinear(features, coef, intercept, info)

    def finish(self, g: Gram, coef: np.ndarray, **info) -> tuple[np.ndarray, float, dict]:
        return coef, g.intercept(coef, self.params.get("fit_intercept", True)), info

    def moments(self, g: Gram):
        return g.moments(self.params.get("fit_intercept", True))


def least_squares(c: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Minimum-norm solution in correlation scale, so that unit choices do not hide small columns."""
    s = np.sqrt(np.maximum(np.diag(c), 0.0))
    s[s == 0.0] = 1.0
    return np.linalg.pinv(c / np.outer(s, s), rcond=1e-12, hermitian=True) @ (v / s) / s


def coordinate_descent(c: np.ndarray, v: np.ndarray, l1: float, l2: float, positive: bool = False,
                       max_iter: int = 1000, tol: float = 1e-4, start: np.ndarray | None = None,
                       scale: float = 1.0) -> np.ndarray:
    """Minimise b'Cb/2 - v'b + l1*|b|_1 + l2*|b|^2/2."""
    b = np.zeros(len(v)) if start is None else start.copy()
    residual = v - c @ b
    diagonal = np.diag(c)
    floor = min(tol, 1e-7) * scale
    for _ in range(max_iter):
        moved = 0.0
        for j in range(len(v)):
            if diagonal[j] <= 0.0:
                continue
            old = b[j]
            rho = residual[j] + diagonal[j] * old
            new = max(rho - l1, 0.0) - (0.0 if positive else max(-rho - l1, 0.0))
            new /= diagonal[j] + l2
            if new != old:
                residual -= c[:, j] * (new - old)
                b[j] = new
                moved = max(moved, abs(new - old) * np.sqrt(diagonal[j]))
        if moved <= floor:
            break
    return b


def angle_path(c: np.ndarray, v: np.ndarray, lasso: bool, max_active: int, min_alpha: float = 0.0,
               positive: bool = False, max_iter: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Least-angle path on a Gram (Efron et al. 2004): (alphas, coefficients per knot)."""
    p = len(v)
    b, active, dropped = np.zeros(p), [], False
    top = float(np.max(v if positive else np.abs(v))) if p else 0.0
    alphas, knots = [max(top, 0.0)], [b.copy()]
    eps = 1e-12 * max(top, 1e-300)
    for _ in range(max_iter):
        cov = v - c @ b
        if not dropped:
            rest = [j for j in range(p) if j not in active and c[j, j] > 0]
            if not rest or len(active) >= max_active:
                if not active:
                    break
            else:
                j = max(rest, key=lambda k: cov[k] if positive else abs(cov[k]))
                if (cov[j] if positive else abs(cov[j])) <= eps:
                    break
                trial = [*active, j]
                if np.linalg.matrix_rank(c[np.ix_(trial, trial)], tol=1e-10 * np.trace(c) / p) == len(trial):
                    active = trial
                elif not active:
                    break
        level = max(abs(cov[active]))
        if level <= max(eps, min_alpha):
            break
        signs = np.sign(cov[active])
        w = np.linalg.solve(c[np.ix_(active, active)], signs)
        drift = c[:, active] @ w
        step = level - min_alpha
        rest = [j for j in range(p) if j not in active and c[j, j] > 0]
        if len(active) < max_active:
            for j in rest:
                for gap, speed in ((level - cov[j], 1.0 - drift[j]), *(() if positive else ((level + cov[j], 1.0 + drift[j]),))):
                    if speed > 1e-14 and gap / speed > eps:
                        step = min(step, gap / speed)
        leaving = None
        if lasso:
            for i, j in enumerate(active):
                if b[j] != 0.0 and w[i] != 0.0:
                    back = -b[j] / w[i]
                    if eps < back < step:
                        step, leaving = back, j
        b[active] += step * w
        dropped = leaving is not None
        if dropped:
            b[leaving] = 0.0
            active.remove(leaving)
        alphas.append(level - step)
        knots.append(b.copy())
        if alphas[-1] <= min_alpha + eps or (len(active) >= max_active and not dropped and not lasso
                                            and alphas[-1] <= eps):
            break
    return np.array(alphas), np.array(knots)


def at_alpha(alphas: np.ndarray, knots: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients between two knots of a piecewise-linear path."""
    order = np.argsort(alphas)
    return np.array([np.interp(alpha, alphas[order], knots[order, j]) for j in range(knots.shape[1])])


def mean_fold_error(blocks: dict[int, Gram], solve_many, fit_intercept: bool) -> np.ndarray:
    """Average validation MSE per candidate; solve_many(train Gram) -> list of coefficient vectors."""
    whole = total(blocks)
    errors = []
    for g in blocks.values():
        train = whole - g
        errors.append([g.mse(b, train.intercept(b, fit_intercept)) for b in solve_many(train)])
    return np.mean(np.array(errors), axis=0)


class LinearRegression(GramRegressor):
    defaults = {"fit_intercept": True}

    def solve(self, g, folds=None):
        c, v, _ = self.moments(g)
        return self.finish(g, least_squares(c, v))


class Ridge(GramRegressor):
    defaults = {"alpha": 1.0, "fit_intercept": True}

    def solve(self, g, folds=None):
        c, v, _ = self.moments(g)
        return self.finish(g, np.linalg.solve(c + np.eye(len(v)) * self.params["alpha"] / g.n, v))


class RidgeCV(Regressor):
    """Ridge with leave-one-out choice of alpha; all alphas are scored in one extra scan."""

    defaults = {"alphas": (0.1, 1.0, 10.0), "fit_intercept": True}

    def fit(self, df, features, target):
        g = total(grams(df, features, target))
        keep, p = self.params["fit_intercept"], len(features)
        c, v, _ = g.moments(keep)
        alphas = list(self.params["alphas"])
        inverses = [np.linalg.inv(c * g.n + np.eye(p) * a) for a in alphas]
        coefs = [inv @ (v * g.n) for inv in inverses]
        centre = g.xmean if keep else np.zeros(p)
        icepts, base = [g.intercept(b, keep) for b in coefs], 1.0 / g.n if keep else 0.0

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(alphas))
            for batch in batches:
                x, y = matrix(batch, p), batch.column(p).to_numpy(zero_copy_only=False).astype(float)
                d = x - centre
                for i, inv in enumerate(inverses):
                    leverage = base + ((d @ inv) * d).sum(1)
                    out[i] += (((y - x @ coefs[i] - icepts[i]) / (1.0 - leverage)) ** 2).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)],
                                             names=["k", "v"])

        rows = (numeric_view(df, features, target).mapInArrow(score, "k int, v double")
                .groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect())
        best = int(np.argmin([r["v"] for r in rows]))
        return FittedLinear(features, coefs[best], icepts[best], {"alpha": alphas[best]})


class ElasticNet(GramRegressor):
    defaults = {"alpha": 1.0, "l1_ratio": 0.5, "fit_intercept": True, "max_iter": 1000, "tol": 1e-4,
                "positive": False}

    def solve(self, g, folds=None):
        c, v, w = self.moments(g)
        a, ratio = self.params["alpha"], min(self.params["l1_ratio"], 1.0)
        b = coordinate_descent(c, v, a * ratio, a * (1 - ratio), self.params["positive"], self.params["max_iter"],
                               self.params["tol"], scale=np.sqrt(max(w, 1e-300)))
        return self.finish(g, b)


class Lasso(ElasticNet):
    defaults = {**ElasticNet.defaults, "l1_ratio": 1.0}


class ElasticNetCV(GramRegressor):
    defaults = {"l1_ratio": 0.5, "eps": 1e-3, "n_alphas": 100, "fit_intercept": True, "max_iter": 1000,
                "tol": 1e-4, "cv": 5, "positive": False}
    inner_folds = 5

    def _path(self, g: Gram, alphas: Sequence[float]) -> list[np.ndarray]:
        c, v, w = self.moments(g)
        ratio, out, b = self.params["l1_ratio"], [], None
        for a in alphas:
            b = coordinate_descent(c, v, a * ratio, a * (1 - ratio), self.params["positive"],
                                   self.params["max_iter"], self.params["tol"], b, np.sqrt(max(w, 1e-300)))
            out.append(b)
        return out

    def solve(self, g, folds=None):
        _, v, _ = self.moments(g)
        ratio = max(self.params["l1_ratio"], 1e-3)
        top = max(float(np.max(v if self.params["positive"] else np.abs(v))) / ratio, 1e-12)
        alphas = np.geomspace(top, top * self.params["eps"], int(self.params["n_alphas"]))
        errors = mean_fold_error(folds, lambda train: self._path(train, alphas), self.params["fit_intercept"])
        best = int(np.argmin(errors))
        return self.finish(g, self._path(g, alphas[:best + 1])[-1], alpha=float(alphas[best]))


class LassoCV(ElasticNetCV):
    defaults = {**ElasticNetCV.defaults, "l1_ratio": 1.0}


class Lars(GramRegressor):
    defaults = {"n_nonzero_coefs": 500, "fit_intercept": True, "eps": 2.220446049250313e-16}

    def solve(self, g, folds=None):
        c, v, _ = self.moments(g)
        _, knots = angle_path(c, v, False, int(self.params["n_nonzero_coefs"]))
        return self.finish(g, knots[-1])


class LassoLars(GramRegressor):
    defaults = {"alpha": 1.0, "fit_intercept": True, "max_iter": 500, "positive": False,
                "eps": 2.220446049250313e-16}

    def solve(self, g, folds=None):
        c, v, _ = self.moments(g)
        alphas, knots = angle_path(c, v, True, len(v), self.params["alpha"], self.params["positive"],
                                   int(self.params["max_iter"]))
        return self.finish(g, knots[-1] if alphas[0] > self.params["alpha"] else np.zeros(len(v)))


class LarsCV(GramRegressor):
    defaults = {"fit_intercept": True, "max_iter": 500, "cv": 5, "max_n_alphas": 1000,
                "eps": 2.220446049250313e-16, "positive": False}
    inner_folds = 5
    lasso = False

    def _path(self, g: Gram):
        c, v, _ = self.moments(g)
        return angle_path(c, v, self.lasso, len(v), 0.0, self.params["positive"], int(self.params["max_iter"]))

    def solve(self, g, folds=None):
        whole = total(folds)
        paths = {f: self._path(whole - b) for f, b in folds.items()}
        grid = np.unique(np.concatenate([a for a, _ in paths.values()]))
        room = int(self.params["max_n_alphas"])
        if len(grid) > room:
            grid = grid[np.linspace(0, len(grid) - 1, room).astype(int)]
        errors = np.zeros(len(grid))
        for f, b in folds.items():
            train = whole - b
            for i, a in enumerate(grid):
                coef = at_alpha(*paths[f], a)
                errors[i] += b.mse(coef, train.intercept(coef, self.params["fit_intercept"])) / len(folds)
        alpha = float(grid[int(np.argmin(errors))])
        return self.finish(g, at_alpha(*self._path(g), alpha), alpha=alpha)


class LassoLarsCV(LarsCV):
    lasso = True


class LassoLarsIC(GramRegressor):
    """Knot of the lasso path with the smallest information criterion (noise from the full fit)."""

    defaults = {"criterion": "aic", "fit_intercept": True, "max_iter": 500, "positive": False,
                "eps": 2.220446049250313e-16}

    def solve(self, g, folds=None):
        c, v, w = self.moments(g)
        alphas, knots = angle_path(c, v, True, len(v), 0.0, self.params["positive"], int(self.params["max_iter"]))
        full = least_squares(c, v)
        spare = g.n - len(v) - (1 if self.params["fit_intercept"] else 0)
        if spare <= 0:
            raise ValueError("the criterion needs more rows than features")
        noise = max(w - 2 * full @ v + full @ c @ full, 1e-300) * g.n / spare
        price = 2.0 if self.params["criterion"] == "aic" else np.log(g.n)
        scores = [g.n * np.log(2 * np.pi * noise) + g.n * (w - 2 * b @ v + b @ c @ b) / noise
                  + price * np.count_nonzero(b) for b in knots]
        best = int(np.argmin(scores))
        return self.finish(g, knots[best], alpha=float(alphas[best]), criterion=float(scores[best]))


def matching_pursuit(c: np.ndarray, v: np.ndarray, steps: int) -> list[np.ndarray]:
    """Greedy selection with a full refit after each step; one coefficient vector per step."""
    chosen, out = [], []
    b = np.zeros(len(v))
    for _ in range(min(steps, len(v))):
        cov = v - c @ b
        cov[chosen] = 0.0
        j = int(np.argmax(np.abs(cov)))
        if cov[j] == 0.0:
            break
        chosen.append(j)
        b = np.zeros(len(v))
        b[chosen] = least_squares(c[np.ix_(chosen, chosen)], v[chosen])
        out.append(b)
    return out or [b]


class OrthogonalMatchingPursuit(GramRegressor):
    defaults = {"n_nonzero_coefs": None, "tol": None, "fit_intercept": True}

    def solve(self, g, folds=None):
        c, v, w = self.moments(g)
        if self.params["tol"] is not None:
            for b in matching_pursuit(c, v, len(v)):
                if (w - 2 * b @ v + b @ c @ b) * g.n <= self.params["tol"]:
                    break
            return self.finish(g, b)
        k = self.params["n_nonzero_coefs"] or max(int(0.1 * len(v)), 1)
        return self.finish(g, matching_pursuit(c, v, int(k))[-1])


class OrthogonalMatchingPursuitCV(GramRegressor):
    defaults = {"fit_intercept": True, "cv": 5, "max_iter": None}
    inner_folds = 5

    def solve(self, g, folds=None):
        p = len(g.sx)
        steps = self.params["max_iter"] or min(max(int(0.1 * p), 5), p)

        def many(train: Gram):
            found = matching_pursuit(*self.moments(train)[:2], steps)
            return found + [found[-1]] * (steps - len(found))

        best = int(np.argmin(mean_fold_error(folds, many, self.params["fit_intercept"]))) + 1
        c, v, _ = self.moments(g)
        return self.finish(g, matching_pursuit(c, v, best)[-1], n_nonzero_coefs=best)


class BayesianRidge(GramRegressor):
    """Evidence maximisation over the eigenvalues of the Gram (MacKay 1992; Tipping 2001)."""

    defaults = {"max_iter": 300, "tol": 1e-3, "alpha_1": 1e-6, "alpha_2": 1e-6, "lambda_1": 1e-6, "lambda_2": 1e-6,
                "alpha_init": None, "lambda_init": None, "fit_intercept": True}

    def solve(self, g, folds=None):
        c, v, w = self.moments(g)
        values, vectors = np.linalg.eigh(c * g.n)
        values = np.maximum(values, 0.0)
        rotated = vectors.T @ (v * g.n)
        o = self.params
        noise = o["alpha_init"] or 1.0 / max(w, 1e-300)
        weight = o["lambda_init"] or 1.0
        b = np.zeros(len(v))
        for i in range(int(o["max_iter"])):
            new = vectors @ (rotated / (values + weight / noise))
            error = max(w - 2 * new @ v + new @ c @ new, 0.0) * g.n
            freedom = float(np.sum(noise * values / (weight + noise * values)))
            weight = (freedom + 2 * o["lambda_1"]) / (float(new @ new) + 2 * o["lambda_2"])
            noise = (g.n - freedom + 2 * o["alpha_1"]) / (error + 2 * o["alpha_2"])
            done = i > 0 and np.abs(new - b).sum() < o["tol"]
            b = new
            if done:
                break
        b = vectors @ (rotated / (values + weight / noise))
        return self.finish(g, b, alpha=noise, lambda_=weight)
