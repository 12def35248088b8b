"""Regressors backed by Spark ML estimators, and boosting by reweighted trees."""

from __future__ import annotations

import math
import warnings
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import regression as M
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double, clean_double_sql
from tabreg.models.base import Fitted, FittedLinear, FittedSpark, Regressor, assemble
from tabreg.models.linear import Ridge
from tabreg.models.trees import CELLS, Tree, _blocked, _blocks
from tabreg.sources.storage import cut_lineage, discard, pieces, spread

LABEL = "__y"


def prepared(df: DataFrame, features, target) -> DataFrame:
    narrow = df.select(*[F.expr(f"{clean_double_sql(c)} AS `{c}`") for c in features],
                       clean_double(target).alias(LABEL))
    return assemble(pieces(narrow, df.count()), features).select("__x", LABEL)


class SparkRegressor(Regressor):
    """Maps the public parameter names to one Spark ML estimator."""

    defaults: dict = {}
    ignored: tuple[str, ...] = ()

    def __init__(self, **params):
        dropped = [k for k in params if k in self.ignored]
        if dropped:
            warnings.warn(f"{type(self).__name__}: no Spark counterpart for {dropped}; ignored", stacklevel=2)
        super().__init__(**{k: v for k, v in params.items() if k not in self.ignored})

    def estimator(self, p: int):
        raise NotImplementedError

    def fit(self, df, features, target) -> Fitted:
        est = self.estimator(len(features))
        model = est.setFeaturesCol("__x").setLabelCol(LABEL).fit(prepared(df, features, target))
        weights = model.featureImportances.toArray() if hasattr(model, "featureImportances") else None
        return FittedSpark(features, model, weights)


def depth(value) -> int:
    """Spark trees are limited to depth 30."""
    return 30 if value is None else max(1, min(30, int(value)))


def subset(value) -> str:
    if value is None or value in ("all", "auto"):
        return "all" if value != "auto" else "auto"
    if value == "log2" or value == "sqrt":
        return value
    return str(float(min(1.0, value))) if isinstance(value, float) else str(int(value))


TREE_IGNORED = ("criterion", "splitter", "max_leaf_nodes", "min_samples_split", "oob_score", "ccp_alpha",
                "monotonic_cst", "bootstrap_features", "warm_start", "n_jobs", "verbose")


class DecisionTree(SparkRegressor):
    defaults = {"max_depth": None, "min_samples_leaf": 1, "min_weight_fraction_leaf": 0.0,
                "min_impurity_decrease": 0.0, "random_state": 42, "max_bins": 32}
    ignored = (*TREE_IGNORED, "max_features")

    def estimator(self, p):
        o = self.params
        return M.DecisionTreeRegressor(
            maxDepth=depth(o["max_depth"]), minInstancesPerNode=int(o["min_samples_leaf"]),
            minWeightFractionPerNode=min(float(o["min_weight_fraction_leaf"]), 0.499),
            minInfoGain=float(o["min_impurity_decrease"]), maxBins=int(o["max_bins"]), seed=int(o["random_state"] or 42))


class RandomForest(SparkRegressor):
    defaults = {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1, "max_features": "all",
                "bootstrap": True, "min_weight_fraction_leaf": 0.0, "min_impurity_decrease": 0.0, "max_samples": 1.0,
                "random_state": 42, "max_bins": 32}
    ignored = TREE_IGNORED

    def estimator(self, p):
        o = self.params
        return M.RandomForestRegressor(
            numTrees=int(o["n_estimators"]), maxDepth=depth(o["max_depth"]),
            minInstancesPerNode=int(o["min_samples_leaf"]), featureSubsetStrategy=subset(o["max_features"]),
            bootstrap=bool(o["bootstrap"]), minWeightFractionPerNode=min(float(o["min_weight_fraction_leaf"]), 0.499),
            minInfoGain=float(o["min_impurity_decrease"]), subsamplingRate=min(1.0, float(o["max_samples"])),
            maxBins=int(o["max_bins"]), seed=int(o["random_state"] or 42))


class Bagging(RandomForest):
    """Bagged trees: a forest that looks at every feature at each split."""

    defaults = {**RandomForest.defaults, "n_estimators": 10}

    def __init__(self, **params):
        if isinstance(params.get("max_features"), float):
            params["max_features"] = min(1.0, params["max_features"])
        super().__init__(**params)


class GradientBoosting(SparkRegressor):
    defaults = {"loss": "squared", "learning_rate": 0.1, "n_estimators": 100, "subsample": 1.0, "max_depth": 3,
                "min_samples_leaf": 1, "max_features": "all", "min_weight_fraction_leaf": 0.0,
                "min_impurity_decrease": 0.0, "random_state": 42, "max_bins": 32, "validation_column": None,
                "tol": 0.01}
    ignored = (*TREE_IGNORED, "n_iter_no_change", "validation_fraction")

    def estimator(self, p):
        o = self.params
        absolute = str(o["loss"]) in ("absolute", "absolute_error", "lad")
        if str(o["loss"]) not in ("squared", "squared_error", "ls", "absolute", "absolute_error", "lad"):
            raise ValueError("loss must be squared or absolute")
        est = M.GBTRegressor(
            lossType="absolute" if absolute else "squared", stepSize=min(1.0, float(o["learning_rate"])),
            maxIter=int(o["n_estimators"]), subsamplingRate=min(1.0, float(o["subsample"])),
            maxDepth=depth(o["max_depth"]), minInstancesPerNode=max(1, int(o["min_samples_leaf"])),
            featureSubsetStrategy=subset(o["max_features"]), maxBins=int(o["max_bins"]),
            minWeightFractionPerNode=min(float(o["min_weight_fraction_leaf"]), 0.499),
            minInfoGain=float(o["min_impurity_decrease"]), seed=int(o["random_state"] or 42))
        if o["validation_column"]:
            est = est.setValidationIndicatorCol(o["validation_column"]).setValidationTol(float(o["tol"]))
        return est


class HistGradientBoosting(GradientBoosting):
    defaults = {**GradientBoosting.defaults, "max_iter": 100, "max_bins": 255, "max_depth": 5, "min_samples_leaf": 20}
    ignored = (*GradientBoosting.ignored, "l2_regularization", "categorical_features", "early_stopping")

    def estimator(self, p):
        return self.with_params(n_estimators=self.params["max_iter"])._boosted(p)

    def _boosted(self, p):
        return GradientBoosting.estimator(self, p)


class Huber(SparkRegressor):
    defaults = {"epsilon": 1.35, "alpha": 1e-4, "max_iter": 100, "fit_intercept": True, "tol": 1e-5}

    def fit(self, df, features, target):
        o, n = self.params, df.count()
        model = M.LinearRegression(
            featuresCol="__x", labelCol=LABEL, loss="huber", solver="l-bfgs", standardization=False,
            epsilon=max(float(o["epsilon"]), 1.0 + 1e-6), regParam=float(o["alpha"]) / n, maxIter=int(o["max_iter"]),
            fitIntercept=bool(o["fit_intercept"]), tol=float(o["tol"])).fit(prepared(df, features, target))
        return FittedLinear(features, model.coefficients.toArray(), model.intercept, {"scale": model.scale})


class FittedLog(Fitted):
    """exp of a linear rule."""

    def __init__(self, inner: FittedLinear):
        self.inner, self.features, self.coef, self.intercept = inner, inner.features, inner.coef, inner.intercept

    def predict(self, df, name="prediction"):
        return df.withColumn(name, F.exp(self.inner.column()))


class Tweedie(SparkRegressor):
    """Generalised linear model with variance power 0, 1 or 2 and an L2 penalty."""

    defaults = {"power": 0, "alpha": 1.0, "link": "auto", "fit_intercept": True, "max_iter": 100, "tol": 1e-4}
    ignored = ("solver",)

    def fit(self, df, features, target):
        o = self.params
        link = o["link"] if o["link"] != "auto" else ("identity" if o["power"] <= 0 else "log")
        if o["power"] == 0 and link == "identity":  # plain ridge on the mean squared error
            return Ridge(alpha=float(o["alpha"]) * df.count(), fit_intercept=o["fit_intercept"]).fit(df, features, target)
        # Spark divides each reweighted fit by the sum of its weights (mean^(2 - power) under the log link)
        unit = df.agg(F.avg(F.pow(clean_double(target), F.lit(2.0 - o["power"])))).first()[0] if link == "log" else 1.0
        model = M.GeneralizedLinearRegression(
            featuresCol="__x", labelCol=LABEL, family="tweedie", variancePower=float(o["power"]),
            linkPower=1.0 if link == "identity" else 0.0, regParam=float(o["alpha"]) / unit, maxIter=int(o["max_iter"]),
            tol=float(o["tol"]), fitIntercept=bool(o["fit_intercept"])).fit(prepared(df, features, target))
        rule = FittedLinear(features, model.coefficients.toArray(), model.intercept)
        return rule if link == "identity" else FittedLog(rule)


class Poisson(Tweedie):
    defaults = {**Tweedie.defaults, "power": 1}


class Gamma(Tweedie):
    defaults = {**Tweedie.defaults, "power": 2}


class FittedMedianTrees(Fitted):
    """Weighted median of the rounds' predictions."""

    def __init__(self, features, trees, weights):
        self.features, self.trees, self.weights = list(features), list(trees), [float(w) for w in weights]

    def medians(self, x: np.ndarray) -> np.ndarray:
        votes = np.column_stack([t.predict(x) for t in self.trees])
        order = np.argsort(votes, axis=1, kind="stable")
        reached = np.cumsum(np.array(self.weights)[order], axis=1) >= sum(self.weights) / 2.0
        return np.take_along_axis(votes, np.take_along_axis(order, reached.argmax(axis=1)[:, None], 1), 1)[:, 0]

    def predict(self, df, name="prediction"):
        held = df.sparkSession.sparkContext.broadcast(self.medians)  # as large as the model

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in cols])
            if np.isnan(x).any():
                raise ValueError("AdaBoost needs complete rows: impute missing cells first")
            return pd.Series(held.value(np.asfortranarray(x)))

        return df.withColumn(name, score(*[F.expr(clean_double_sql(c)) for c in self.features]))


def weighted_cuts(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 cuts, midway between neighbouring values, that leave about equal weights between them."""
    seen, at = np.unique(values, return_inverse=True)
    between = (seen[:-1] + seen[1:]) / 2.0
    if len(between) < bins:
        return between
    upto = np.cumsum(np.bincount(at, weights))
    stride = upto[-1] / bins
    cuts, goal = [], stride
    for before, after, cut in zip(upto[:-1].tolist(), upto[1:].tolist(), between.tolist(), strict=True):
        if abs(before - goal) < abs(after - goal):
            cuts.append(cut)
            goal += stride
    return np.array(cuts)


class AdaBoost(Regressor):
    """AdaBoost.R2 (Drucker 1997) with row weights instead of resampling.

    Each round adds a weighted tree of variance splits between at most ``BINS`` bins a feature, cut anew at weighted quantiles of about
    ``CUT_ROWS`` rows as Spark ML does. Rows lie in blocks, with the round's bin codes and weights beside them; a scan adds up (node,
    feature, bin), Spark picks each node's best split, and codes and weights are written out after the tree, so that neither the plan nor the work of a round grows
    with the number of rounds.
    """

    defaults = {"n_estimators": 50, "learning_rate": 1.0, "loss": "linear", "max_depth": 3, "random_state": 42}
    BINS, CUT_ROWS = 32, 10_000

    def fit(self, df, features, target):
        o, p = self.params, len(features)
        if o["loss"] not in ("linear", "square", "exponential"):
            raise ValueError("loss must be linear, square or exponential")
        rate = float(o["learning_rate"])
        names = [f"x{i}" for i in range(p)]
        narrow = df.select(*[F.expr(clean_double_sql(c)).alias(x) for x, c in zip(names, features)], clean_double(target).alias("y"))
        bad = " or ".join([*(f"{x} is null or abs({x}) = double('Infinity')" for x in names), "y is null"])
        n, unfit = narrow.agg(F.count(F.lit(1)), F.count_if(F.expr(bad))).first()
        if unfit:
            raise ValueError("AdaBoost needs complete rows: impute missing cells first")
        if not n:
            raise ValueError("no rows to fit")
        share = max(self.BINS ** 2, self.CUT_ROWS) / n
        seed, bins = int(o["random_state"] or 42), max(1, min(self.BINS, n))
        some = (narrow if share >= 1 else narrow.where(F.rand(seed) < share)).select(*names).toPandas()  # about CUT_ROWS rows
        cuts = [weighted_cuts(some[x].to_numpy(), np.ones(len(some)), bins) for x in names]
        rows = cut_lineage(spread(_blocked(narrow, _first_blocks(cuts, share, seed), _columns(p))))
        trees, votes = [], []
        for i in range(int(o["n_estimators"])):
            coded = self._grow(rows, cuts, depth(o["max_depth"]))
            places = [float(cuts[f][int(c)]) if f >= 0 else 0.0 for f, c in zip(coded.feature, coded.threshold, strict=True)]
            tree = replace(coded, threshold=np.array(places))
            top, weight, *moments = self._errors(rows, coded, p, None)
            if not top:
                trees.append(tree)
                votes.append(1.0)
                break
            if o["loss"] == "exponential":
                moments = self._errors(rows, coded, p, top)[2:]
            mean = {"linear": moments[0] / top, "square": moments[1] / top / top, "exponential": moments[2]}[o["loss"]] / weight
            if mean >= 0.5:
                if not trees:
                    trees.append(tree)
                    votes.append(1.0)
                break
            beta = max(mean, 1e-300) / (1 - mean)
            trees.append(tree)
            votes.append(rate * math.log(1 / beta))
            if i + 1 < int(o["n_estimators"]):
                # dividing by the mean weight keeps the column near 1
                step = _Step(top, o["loss"], weight / n, beta, rate)
                cuts = self._next_cuts(rows, tree, p, bins, step)
                after = cut_lineage(self._reweighted(rows, coded, cuts, share, seed + i + 1, step))
                discard(rows)
                rows = after
        discard(rows)
        return FittedMedianTrees(features, trees, votes)

    @staticmethod
    def _next_cuts(rows: DataFrame, tree: Tree, p: int, bins: int, step: _Step) -> list[np.ndarray]:
        """Cuts of every feature for the coming round, from the rows set aside in the blocks and their new weights."""
        def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = np.concatenate([np.frombuffer(v.as_buffer(), "f8").reshape(p + 2, -1) for v in batch.column(0)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)

        names = [*(f"x{i}" for i in range(p)), "y", "w"]
        got = rows.select("some").mapInArrow(some, ", ".join(f"{c} double" for c in names)).toPandas().to_numpy()
        x = list(got[:, :p].T)
        weights = step.after(got[:, p + 1], np.abs(got[:, p] - tree.predict(got[:, :p])))
        return [weighted_cuts(c, weights, bins) for c in x]

    def _grow(self, rows: DataFrame, cuts: list[np.ndarray], levels: int) -> Tree:
        nodes = [[-1, 0.0, -1, -1, 0.0, False, 0.0]]  # as Tree.of takes them
        open_nodes = [0]
        for level in range(levels):
            found: dict[int, tuple] = {}
            step = max(1, CELLS // max(1, len(cuts) * self.BINS))
            for start in range(0, len(open_nodes), step):
                found |= self._splits(rows, Tree.of(nodes), open_nodes[start:start + step], [len(c) for c in cuts])
            open_nodes = []
            for node, (gain, f, cut, left, right) in sorted(found.items()):
                weight, total = left[0] + right[0], left[1] + right[1]
                nodes[node][4], nodes[node][6] = total / weight if weight else 0.0, weight
                if not gain > 0:
                    continue
                nodes[node][:4] = [f, cut, len(nodes), len(nodes) + 1]
                for w, wy, wyy in (left, right):
                    if level + 1 < levels and w and abs((wyy - wy * wy / w) / w) >= np.finfo(float).eps:
                        open_nodes.append(len(nodes))
                    nodes.append([-1, 0.0, -1, -1, wy / w if w else 0.0, False, w])
            if not open_nodes:
                break
        return Tree.of(nodes)

    @staticmethod
    def _splits(rows: DataFrame, growing: Tree, wanted: Sequence[int], sizes: list[int]) -> dict[int, tuple]:
        """By wanted node: gain, feature, place of the cut, and (weight, sum, sum of squares) on either side of the best split, from one
        scan; the root's sums lie in the blocks already."""
        p, width = len(sizes), max(sizes) + 1
        slots = np.full(len(growing.feature), -1)
        slots[list(wanted)] = np.arange(len(wanted))
        held = rows.sparkSession.sparkContext.broadcast((growing, slots))
        at_root = len(slots) == 1

        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, slot_of = held.value
            total = np.zeros((4, p, len(wanted) * width))
            if at_root:
                for batch in batches:
                    for v in batch.column(0):
                        total += np.frombuffer(v.as_buffer(), "f8").reshape(total.shape)
            else:
                for x, (y, w) in _blocks(batches, p, "u1", ("f8", "f8")):
                    found = list(tree.parted(x, slot_of, -1))
                    if found:
                        use = np.concatenate([r for _, r in found])
                        start = np.repeat([s * width for s, _ in found], [len(r) for _, r in found])
                        total += _sums([c[use] for c in x], y[use], w[use], start, total.shape[2])
            total = total.reshape(4, p, len(wanted), width).transpose(2, 1, 0, 3).reshape(-1, 4 * width)
            there = np.flatnonzero(total[:, 3 * width:].any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array([total[k].tobytes() for k in there], pa.binary())], ["k", "cells"])

        def best(cells: pa.Table) -> pa.Table:
            k = cells.column("k")[0].as_py()
            whole = np.sum([np.frombuffer(v.as_buffer(), "f8") for v in cells.column("cells")], axis=0).reshape(4, width).T
            gain, cut, left, right = _variance_split(whole[:sizes[k % p] + 1])
            row = (k, gain, cut, *left.tolist(), *right.tolist())
            return pa.Table.from_pylist([dict(zip(("k", "gain", "cut", "w0", "s0", "q0", "w1", "s1", "q1"), row, strict=True))])

        cells = rows.select(*(["root"] if at_root else [*(f"c{i}" for i in range(p)), "y", "w"])).mapInArrow(sums, "k long, cells binary")
        got = cells.groupBy("k").applyInArrow(best, "k long, gain double, cut long, w0 double, s0 double, q0 double, w1 double, s1 double, q1 double")
        found: dict[int, tuple] = {}
        for r in sorted(got.collect(), key=lambda r: r["k"]):  # one row per node and feature
            node, f = wanted[r["k"] // p], r["k"] % p
            if node not in found or r["gain"] > found[node][0]:
                found[node] = (r["gain"], f, r["cut"], (r["w0"], r["s0"], r["q0"]), (r["w1"], r["s1"], r["q1"]))
        return found

    @staticmethod
    def _errors(rows: DataFrame, tree: Tree, p: int, top: float | None) -> list[float]:
        """Largest error of a row with a weight; sums of the weight, of weight * error, of weight * squared error, and given ``top`` of
        weight * exponential loss."""
        held = rows.sparkSession.sparkContext.broadcast(tree)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, (y, w) in _blocks(batches, p, "u1", ("f8", "f8")):
                error = _error(held.value, x, y)
                sums = [w.sum(), w @ error, w @ (error * error), w @ -np.expm1(-error / top) if top else 0.0]
                yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in (error[w > 0].max(initial=0.0), *sums)], list("tabcd"))

        rows = rows.select(*(f"c{i}" for i in range(p)), "y", "w")
        return list(rows.mapInArrow(run, "t double, a double, b double, c double, d double").agg(F.max("t"), *[F.sum(c) for c in "abcd"]).first())

    @staticmethod
    def _reweighted(rows: DataFrame, tree: Tree, cuts: list[np.ndarray], share: float, seed: int, step: _Step) -> DataFrame:
        held, p = rows.sparkSession.sparkContext.broadcast(tree), len(cuts)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    parts = [memoryview(c[i].as_buffer()) for c in batch.columns]
                    *x, y = [np.frombuffer(b, "f8") for b in parts[:p + 1]]
                    w = np.frombuffer(parts[2 * p + 1], "f8")
                    after = step.after(w, _error(held.value, [np.frombuffer(b, "u1") for b in parts[p + 1:2 * p + 1]], y))
                    made = _block(x, y, after, cuts, share, seed)
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:p + 1], *(pa.array([c.tobytes()], pa.binary()) for c in made)],
                                                     _columns(p))

        columns = _columns(p)
        return rows.select(*columns[:2 * p + 2]).mapInArrow(run, ", ".join(f"{c} binary" for c in columns))


@dataclass
class _Step:
    """How a round changes the weights."""

    top: float
    loss: str
    weight: float
    beta: float
    rate: float

    def after(self, w: np.ndarray, error: np.ndarray) -> np.ndarray:
        unit = error / self.top
        lost = unit if self.loss == "linear" else unit * unit if self.loss == "square" else -np.expm1(-unit)
        return w / self.weight * self.beta ** ((1 - lost) * self.rate)


def _columns(p: int) -> list[str]:
    """Of a block: values, target; the round's bin codes, weights, sums by (feature, bin), and a few rows for the next round's cuts."""
    return [*(f"x{i}" for i in range(p)), "y", *(f"c{i}" for i in range(p)), "w", "root", "some"]


def _block(x: Sequence[np.ndarray], y: np.ndarray, w: np.ndarray, cuts: list[np.ndarray], share: float, seed: int) -> list[np.ndarray]:
    """The columns of a block that change with the round."""
    codes = [np.searchsorted(places, c, side="left").astype("u1") for places, c in zip(cuts, x, strict=True)]
    root = _sums(codes, y, w, 0, max(len(c) for c in cuts) + 1)
    rng = np.random.default_rng([seed, TaskContext.get().partitionId(), zlib.crc32(y.tobytes())])
    use = np.flatnonzero(rng.random(len(y)) < share)
    return [*codes, w, root, np.stack([c[use] for c in (*x, y, w)])]


def _first_blocks(cuts: list[np.ndarray], share: float, seed: int):
    def change(table: pa.Table) -> list[np.ndarray]:
        *x, y = [c.to_numpy() for c in table.columns]
        return [*x, y, *_block(x, y, np.ones(len(y)), cuts, share, seed)]

    return change


def _sums(codes: Sequence[np.ndarray], y: np.ndarray, w: np.ndarray, start: np.ndarray | int, size: int) -> np.ndarray:
    """Weight, weight * target, weight * square and rows by feature and cell, ``start`` being the first cell of a row's node."""
    wy = w * y
    out = np.empty((4, len(codes), size))
    for f, c in enumerate(codes):
        cell = c.astype(np.int64) + start
        for k, v in enumerate((w, wy, wy * y, None)):
            out[k, f] = np.bincount(cell, v, size)
    return out


def _error(tree: Tree, x: Sequence[np.ndarray], y: np.ndarray) -> np.ndarray:
    said = np.empty(len(y))
    for leaf, rows in tree.parted(x, np.where(tree.feature < 0, np.arange(len(tree.feature)), -1)):
        said[rows] = tree.value[leaf]
    return np.abs(y - said)


def _variance_split(cells: np.ndarray) -> tuple[float, int, np.ndarray, np.ndarray]:
    """Gain, place and sides of the split with the largest fall of the weighted variance; ``cells``: bins x (weight, sum, squares, rows)."""
    whole = cells.sum(axis=0)
    left = np.cumsum(cells, axis=0)[:-1]
    right = whole - left

    def spread_of(part):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(part[..., 0] > 0, (part[..., 2] - part[..., 1] ** 2 / part[..., 0]) / part[..., 0], 0.0)

    if whole[0] > 0 and len(left):
        share = left[:, 0] / whole[0]
        gain = spread_of(whole) - share * spread_of(left) - right[:, 0] / whole[0] * spread_of(right)
        gain = np.where((left[:, 3] > 0) & (right[:, 3] > 0) & (gain >= 0), gain, -np.inf)
        if gain.max() > -np.inf:
            at = int(gain.argmax())
            return float(gain[at]), at, left[at, :3], right[at, :3]
    return -math.inf, -1, whole[:3], np.zeros(3)
