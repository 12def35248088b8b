"""Regression trees as flat arrays: second-order boosting, extremely randomised trees, prediction and exact attributions.

Rows are written in the form a fit needs, many to a stored row with a column's values side by side, and scanned once per level (boosting)
or twice (random thresholds). Tasks send sums by (node, feature, bin) or (tree, node, feature); Spark adds them up, picks every node's best
split, and the driver gets one row per node. A tree, never a row, is what the driver holds.
"""

from __future__ import annotations

import heapq
import math
import warnings
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double, clean_double_sql
from tabreg.models.base import PREDICTION, Fitted, Regressor
from tabreg.sources.storage import cut_lineage, discard, spread

CELLS = 2_000_000      # (node, feature, bin) cells that a task holds at a time
KEPT_TREES = 1         # trees evaluated on the fly before the rows' margins are written again
BLOCK_ROWS = 65_536    # rows that lie together in one stored row
LEAF_ROWS = 16         # rows a node from which a batch is parted node by node
LARGEST_DEPTH = 30


# ---- trees -------------------------------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Node 0 is the root; ``feature`` is -1 at leaves. A row goes left if its value is at most ``threshold``; a missing value goes where
    ``missing_left`` says. ``cover`` weighs the training rows of a node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    missing_left: np.ndarray
    cover: np.ndarray

    @staticmethod
    def of(rows: Sequence[tuple]) -> Tree:
        kinds = (np.int32, np.float64, np.int32, np.int32, np.float64, bool, np.float64)
        return Tree(*[np.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)])

    def parted(self, x: Sequence[np.ndarray], slots: np.ndarray, missing: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(slot, its rows) of the nodes whose slot is not negative; only paths to them are walked. ``x``: a column per feature, floats or
        codes among which ``missing`` is the code of a missing value. Children come after their parents."""
        leads = slots >= 0
        for node in range(len(slots) - 1, -1, -1):
            if self.feature[node] >= 0:
                leads[node] |= leads[self.left[node]] or leads[self.right[node]]
        stack = [(0, np.arange(len(x[0])))] if leads[0] else []
        while stack:
            node, rows = stack.pop()
            if slots[node] >= 0:
                yield int(slots[node]), rows
                continue
            v = x[self.feature[node]][rows]
            with np.errstate(invalid="ignore"):
                goes = v <= (self.threshold[node] if missing is None else int(self.threshold[node]))
            if self.missing_left[node]:
                goes |= np.isnan(v) if missing is None else v == missing
            for child, took in ((self.right[node], ~goes), (self.left[node], goes)):
                if leads[child] and len(held := rows[took]):
                    stack.append((child, held))

    def added(self, margin: np.ndarray, weight: float, x: Sequence[np.ndarray], missing: int) -> None:
        """Add ``weight`` times the prediction of rows in codes."""
        for leaf, rows in self.parted(x, np.where(self.feature < 0, np.arange(len(self.feature)), -1), missing):
            margin[rows] += weight * self.value[leaf]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        if len(x) >= LEAF_ROWS * len(self.feature):
            at = np.empty(len(x), np.int64)
            for leaf, rows in self.parted(x.T, np.where(self.feature < 0, np.arange(len(self.feature)), -1)):
                at[rows] = leaf
            return at
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            here = at[rows]
            f = self.feature[here]
            rows, here, f = rows[f >= 0], here[f >= 0], f[f >= 0]
            v = x[rows, f]
            with np.errstate(invalid="ignore"):
                goes = (v <= self.threshold[here]) | (np.isnan(v) & self.missing_left[here])
            at[rows] = np.where(goes, self.left[here], self.right[here])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf_of(x)]

    def paths(self) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
        """Every leaf with its path: (inner node, went left)."""
        stack: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
        while stack:
            node, path = stack.pop()
            if self.feature[node] < 0:
                yield node, path
            else:
                stack.append((int(self.right[node]), [*path, (node, False)]))
                stack.append((int(self.left[node]), [*path, (node, True)]))

    def mean(self) -> float:
        """The prediction averaged over the training rows."""
        leaves = self.feature < 0
        return float((self.value[leaves] * self.cover[leaves]).sum() / self.cover[leaves].sum())


class FittedTrees(Fitted):
    """base + sum of weight * tree, through ``link`` (identity or exp)."""

    def __init__(self, features: Sequence[str], trees: Sequence[Tree], weights: Sequence[float], base: float, link: str = "identity",
                 importances: Sequence[float] | None = None):
        self.features, self.trees, self.weights = list(features), list(trees), [float(w) for w in weights]
        self.base, self.link = float(base), link
        if importances is not None:
            self.importances = dict(zip(self.features, [float(v) for v in importances], strict=True))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, x = np.full(len(x), self.base), np.asfortranarray(x)
        for w, t in zip(self.weights, self.trees, strict=True):
            out += w * t.predict(x)
        return out

    def predict(self, df: DataFrame, name: str = PREDICTION) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast((self.margin, self.link))  # as large as the model

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            margin, link = held.value
            m = margin(np.column_stack([c.to_numpy(float) for c in cols]))
            return pd.Series(np.exp(m) if link == "exp" else m)

        return df.withColumn(name, score(*[F.expr(clean_double_sql(c)) for c in self.features]))


def tree_importances(trees: Sequence[Tree], gains: Sequence[np.ndarray], p: int) -> np.ndarray:
    """Share of the total gain by feature."""
    total = np.zeros(p)
    for t, g in zip(trees, gains, strict=True):
        inner = t.feature >= 0
        np.add.at(total, t.feature[inner], g[inner])
    return total / total.sum() if total.sum() > 0 else total


# ---- exact attributions ------------------------------------------------------------------------------------------------

def _subset_weights(held: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For every pattern (row of 0/1: the row meets a feature's conditions on the path) and feature j, the weighted sum over subsets S of
    the other features:  |S|! (k - 1 - |S|)! / k! * product of ``held`` in S * product of ``share`` outside."""
    n, k = held.shape
    weight = np.array([math.factorial(s) * math.factorial(k - 1 - s) / math.factorial(k) for s in range(k)])
    out = np.empty((n, k))
    for j in range(k):
        poly = np.zeros((n, k))  # coefficient s: subsets of size s
        poly[:, 0] = 1.0
        for size, i in enumerate([i for i in range(k) if i != j]):
            grown = poly * share[i]
            grown[:, 1:size + 2] += poly[:, :size + 1] * held[:, [i]]
            poly = grown
        out[:, j] = poly @ weight
    return out


def tree_attributions(tree: Tree, x: np.ndarray, p: int) -> np.ndarray:
    """Shapley values of one tree's prediction for every row (rows x features), missing features being averaged by the cover of the
    nodes' children. They add up to prediction - ``tree.mean()``."""
    out = np.zeros((len(x), p))
    goes: dict[int, np.ndarray] = {}
    for node in np.flatnonzero(tree.feature >= 0).tolist():
        v = x[:, tree.feature[node]]
        with np.errstate(invalid="ignore"):
            goes[node] = (v <= tree.threshold[node]) | (np.isnan(v) & tree.missing_left[node])
    for leaf, path in tree.paths():
        if not path:
            continue
        held: dict[int, np.ndarray] = {}
        share: dict[int, float] = {}
        for node, went_left in path:
            f = int(tree.feature[node])
            child = tree.left[node] if went_left else tree.right[node]
            met = goes[node] if went_left else ~goes[node]
            held[f] = held[f] & met if f in held else met
            share[f] = share.get(f, 1.0) * float(tree.cover[child] / tree.cover[node])
        fs, k = list(held), len(held)
        code = np.zeros(len(x), np.int64)
        for f in fs:
            code = code << 1 | held[f]
        if k <= 62 and 1 << k > 4096 or k > 62:  # only the patterns that occur
            found, code = np.unique(np.column_stack([held[f] for f in fs]), axis=0, return_inverse=True)
            patterns, code = found.astype(float), code.ravel()
        else:
            patterns = (np.arange(1 << k)[:, None] >> np.arange(k - 1, -1, -1) & 1).astype(float)
        z = np.array([share[f] for f in fs])
        table = tree.value[leaf] * (patterns - z) * _subset_weights(patterns, z)
        out[:, fs] += table[code]
    return out


def attributions(model: FittedTrees, df: DataFrame, ids: Sequence, batch_rows: int = 4096) -> DataFrame:
    """The ``ids`` columns, one exact attribution of the margin per feature, and ``base_value``."""
    features, p = model.features, len(model.features)
    trees, weights = model.trees, model.weights
    held = df.sparkSession.sparkContext.broadcast((trees, weights))
    base = model.base + sum(w * t.mean() for w, t in zip(weights, trees, strict=True))
    rows = df.select(*ids, *[F.expr(clean_double_sql(c)).alias(f"__x{i}") for i, c in enumerate(features)])
    kept = rows.schema.fields[:len(rows.columns) - p]
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                x = np.column_stack([batch.column(len(names) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)])
                total = np.zeros((len(x), p))
                for t, w in zip(*held.value, strict=True):
                    total += w * tree_attributions(t, x, p)
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], *map(pa.array, total.T)], [*names, *features])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{c}` double" for c in features)])
    return rows.mapInArrow(run, schema).withColumn("base_value", F.lit(float(base)))


def trees_of_spark(model, spark, features: Sequence[str]) -> FittedTrees:
    """A Spark ML tree, forest or boosted-tree model as flat arrays, read from its saved node table."""
    from tabreg.sources.storage import shared_path

    path = shared_path(spark, "trees")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData") if "nodeData" in data.columns else F.struct(*data.columns)
    number = F.col("treeID") if "treeID" in data.columns else F.lit(0)
    rows = data.select(number.alias("tree"), node.alias("n")).select("tree", *[F.col(f"n.{c}").alias(c) for c in (
        "id", "prediction", "leftChild", "rightChild", "rawCount")], F.col("n.split.featureIndex").alias("feature"),
        F.get("n.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).collect()  # one row per node of the model
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["tree"], []).append(r)
    trees = []
    for k in sorted(by):
        nodes = sorted(by[k], key=lambda r: r["id"])
        at = {r["id"]: i for i, r in enumerate(nodes)}
        trees.append(Tree.of([(r["feature"] if r["leftChild"] >= 0 else -1, r["threshold"] or 0.0, at.get(r["leftChild"], -1),
                               at.get(r["rightChild"], -1), r["prediction"], False, float(r["rawCount"])) for r in nodes]))
    weights = list(getattr(model, "treeWeights", None) or [1.0])
    if type(model).__name__ == "RandomForestRegressionModel":
        weights = [1.0 / len(trees)] * len(trees)
    return FittedTrees(features, trees, weights, 0.0)


# ---- second-order boosting ---------------------------------------------------------------------------------------------

@dataclass
class _Node:
    depth: int
    split: tuple | None = None       # (gain, feature, bin, missing_left)
    sums: tuple[float, float, float] = (0.0, 0.0, 0.0)  # gradient, hessian, rows
    children: tuple[int, int] | None = None


@dataclass
class Penalty:
    """What makes a split worth it."""

    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    min_split_gain: float = 0.0
    min_child_weight: float = 1.0
    min_child_samples: int = 1

    def pull(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.reg_alpha, 0.0)

    def score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return self.pull(g) ** 2 / np.maximum(h + self.reg_lambda, 1e-300)

    def leaf(self, g: float, h: float) -> float:
        return float(-self.pull(np.float64(g)) / max(h + self.reg_lambda, 1e-300))

    def best(self, cells: np.ndarray) -> tuple[float, int, bool]:
        """Best (gain, bin, missing goes left) of one feature; ``cells``: (bins + 1) x (gradient, hessian, rows), missing values last."""
        whole, missing = cells.sum(axis=0), cells[-1]
        left = np.cumsum(cells[:-1], axis=0)[:-1]
        found = (-np.inf, -1, False)
        for with_missing in ((False, True) if missing[2] else (False,)):
            a = left + missing if with_missing else left
            b = whole - a
            fits = (a[:, 2:] >= self.min_child_samples).ravel() & (b[:, 2:] >= self.min_child_samples).ravel()
            fits &= (a[:, 1] >= self.min_child_weight) & (b[:, 1] >= self.min_child_weight) & (a[:, 2] > 0) & (b[:, 2] > 0)
            gain = self.score(a[:, 0], a[:, 1]) + self.score(b[:, 0], b[:, 1]) - self.score(whole[0], whole[1])
            gain = np.where(fits, gain, -np.inf)
            if len(gain) and gain.max() > found[0]:
                found = (float(gain.max()), int(gain.argmax()), with_missing)
        return found


def mixed(key: np.ndarray, *salts: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit keys and salts, the same wherever a row lies."""
    z = key.astype(np.uint64)
    with np.errstate(over="ignore"):
        for s in salts:
            z = z + np.uint64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)) * 2.0 ** -53


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """Cuts between at most ``bins`` bins of each column, at (sketched) quantiles."""
    ranks = [k / bins for k in range(1, bins)]
    found = df.approxQuantile(list(columns), [0.0, *ranks, 1.0], 1.0 / (8 * bins))
    return [np.unique(np.array(v[1:-1])[np.array(v[1:-1]) < v[-1]]) if v else np.empty(0) for v in found]


OBJECTIVES = {"squared": "identity", "poisson": "exp"}


def derivatives(objective: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == "squared":
        return margin - y, np.ones(len(y))
    mean = np.exp(margin)
    return mean - y, mean


@dataclass
class Booster:
    """One boosted fit over a written table of bin codes."""

    penalty: Penalty
    edges: list[np.ndarray]
    bins: int
    objective: str
    max_depth: int
    max_leaves: int | None
    seed: int
    subsample: float = 1.0
    gains: list[np.ndarray] = field(default_factory=list)

    def _splits(self, rows: DataFrame, recent: list[tuple[Tree, float]], growing: Tree, slots: np.ndarray, wanted: Sequence[int],
                features: Sequence[int], draw: int) -> dict[int, tuple]:
        """By wanted node: (gradient, hessian, rows) and its best split, from one scan."""
        p, width = len(self.edges), self.bins + 1
        held = rows.sparkSession.sparkContext.broadcast((recent, growing, slots))
        objective, share, seed, penalty = self.objective, self.subsample, self.seed, self.penalty
        codes = _code_kind(self.bins)
        rows = rows.select(*[c for c in rows.columns if c != "key" or share < 1.0])

        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, tree, slot_of = held.value
            total = np.zeros((3, len(features), len(wanted) * width))
            for x, (y, margin, *keys) in _blocks(batches, p, codes, ("f8", "f8", "i8")):
                found = list(tree.parted(x, slot_of, width - 1))
                if not found:
                    continue
                use = np.concatenate([rows for _, rows in found])
                slot = np.repeat([s for s, _ in found], [len(rows) for _, rows in found])
                if share < 1.0:
                    kept = mixed(keys[0][use], seed, draw) < share
                    use, slot = use[kept], slot[kept]
                x, margin = [c[use] for c in x], margin[use]
                for t, w in before:
                    t.added(margin, w, x, width - 1)
                g, h = derivatives(objective, margin, y[use])
                start, size = slot * width, total.shape[2]
                for k, f in enumerate(features):
                    cell = start + x[f]
                    total[0, k] += np.bincount(cell, g, size)
                    rows = np.bincount(cell, minlength=size)
                    total[1, k] += rows if objective == "squared" else np.bincount(cell, h, size)
                    total[2, k] += rows
            total = total.reshape(3, len(features), len(wanted), width).swapaxes(1, 2).reshape(3, -1)
            at = np.flatnonzero(total[2])
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[k, at]) for k in range(3))], ["cell", "g", "h", "n"])

        def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for group, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    full = np.zeros((width, 3))
                    for c in cells:
                        full[c["b"]] = c["g"], c["h"], c["n"]
                    out.append((group, *penalty.best(full), *full.sum(axis=0).tolist()))
                yield pa.RecordBatch.from_pylist([dict(zip(("k", "gain", "cut", "missing", "g", "h", "n"), o, strict=True)) for o in out])

        cells = rows.mapInArrow(sums, "cell long, g double, h double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"])
        group, place = F.expr(f"cell div {width}"), F.expr(f"cell % {width}")
        by_feature = cells.groupBy(group.alias("k")).agg(F.collect_list(F.struct(place.alias("b"), "g", "h", "n")).alias("cells"))
        found: dict[int, tuple] = {}
        for r in by_feature.mapInArrow(best, "k long, gain double, cut long, missing boolean, g double, h double, n double").collect():
            node, f = wanted[r["k"] // len(features)], features[r["k"] % len(features)]
            here = (r["gain"], -f)
            if node not in found or here > found[node][0]:
                found[node] = (here, (r["gain"], f, r["cut"], r["missing"]), (r["g"], r["h"], r["n"]))
        return found

    def grow(self, rows: DataFrame, recent: list[tuple[Tree, float]], features: Sequence[int], draw: int) -> Tree:
        """One tree. The best leaf is split first; every scan looks at the children of all leaves that may still be split, so the number
        of scans is about the depth. Nodes that the limit on leaves leaves out are dropped at the end."""
        nodes = [_Node(0)]
        most = math.inf if self.max_leaves is None else self.max_leaves - 1
        pending = [0]
        while pending:
            for start in range(0, len(pending), step := max(1, CELLS // (len(features) * (self.bins + 1)))):
                wanted = pending[start:start + step]
                growing, slots = self._speculative(nodes, wanted)
                for node, (_, split, sums) in self._splits(rows, recent, growing, slots, wanted, features, draw).items():
                    nodes[node].sums = sums
                    nodes[node].split = split if split[0] > self.penalty.min_split_gain and nodes[node].depth < self.max_depth else None
            pending = []
            heap, splits = [(-nodes[0].split[0], 0)] if nodes[0].split else [], 0
            while heap and splits < most:
                if nodes[heap[0][1]].children is None:  # not known yet: look at all that can still be reached
                    for _, node in heapq.nsmallest(len(heap) if most == math.inf else int(most - splits), heap):
                        if nodes[node].children is None:
                            nodes[node].children = (len(nodes), len(nodes) + 1)
                            nodes += [_Node(nodes[node].depth + 1), _Node(nodes[node].depth + 1)]
                            pending += nodes[node].children
                    break
                splits += 1
                for child in nodes[heapq.heappop(heap)[1]].children:
                    if nodes[child].split:
                        heapq.heappush(heap, (-nodes[child].split[0], child))
        return self._finished(nodes, most)

    def _speculative(self, nodes: list[_Node], wanted: Sequence[int]) -> tuple[Tree, np.ndarray]:
        slot = {node: k for k, node in enumerate(wanted)}
        rows, slots = [], []
        for k, n in enumerate(nodes):
            left, right = n.children or (-1, -1)
            f, cut, missing = (n.split[1], n.split[2], n.split[3]) if n.children else (-1, 0, False)
            rows.append((f, cut, left, right, 0.0, missing, 0.0))
            slots.append(slot.get(k, -1) if not n.children else -1)
        return Tree.of(rows), np.array(slots)

    def _finished(self, nodes: list[_Node], most: float) -> Tree:
        """The tree in bin codes after the best splits, at most ``most``."""
        heap, kept, splits = [(-nodes[0].split[0], 0)] if nodes[0].split else [], set(), 0
        while heap and splits < most:
            node = heapq.heappop(heap)[1]
            kept.add(node)
            splits += 1
            for child in nodes[node].children:
                if nodes[child].split:
                    heapq.heappush(heap, (-nodes[child].split[0], child))
        order, at = [0], {0: 0}
        for node in order:
            if node in kept:
                for child in nodes[node].children:
                    at[child] = len(order)
                    order.append(child)
        rows, gains = [], []
        for node in order:
            n = nodes[node]
            inner = node in kept
            left, right = (at[c] for c in n.children) if inner else (-1, -1)
            rows.append((n.split[1] if inner else -1, n.split[2] if inner else 0, left, right, self.penalty.leaf(*n.sums[:2]),
                         bool(inner and n.split[3]), n.sums[1]))
            gains.append(n.split[0] if inner else 0.0)
        self.gains.append(np.array(gains))
        return Tree.of(rows)

    def in_values(self, tree: Tree) -> Tree:
        """A tree over bin codes as one over the columns' values."""
        cuts = [self.edges[f][int(c)] if f >= 0 and int(c) < len(self.edges[f]) else np.inf for f, c in zip(tree.feature, tree.threshold, strict=True)]
        return Tree(tree.feature, np.array(cuts), tree.left, tree.right, tree.value, tree.missing_left, tree.cover)


def _code_kind(bins: int) -> str:
    """Codes 0 .. bins - 1, and ``bins`` for a missing value."""
    return "u1" if bins < 256 else "u2" if bins < 65_536 else "i4"


def _blocks(batches: Iterable[pa.RecordBatch], p: int, kind: str, rest: Sequence[str]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """The columns of ``p`` features and the others of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            parts = [memoryview(c[i].as_buffer()) for c in batch.columns]
            yield ([np.frombuffer(b, kind) for b in parts[:p]], [np.frombuffer(b, k) for b, k in zip(parts[p:], rest, strict=False)])


def _blocked(df: DataFrame, change, names: Sequence[str]) -> DataFrame:
    """Up to BLOCK_ROWS rows in one, each column as the bytes that ``change`` makes of an Arrow table's columns."""
    most = BLOCK_ROWS

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        made = change(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in made], list(names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, most):
                batch = whole.slice(start, most)
                if held and count + batch.num_rows > most:
                    yield block(held)
                    held, count = [], 0
                held.append(batch)
                count += batch.num_rows
        if held:
            yield block(held)

    return df.mapInArrow(run, ", ".join(f"{c} binary" for c in names))


class SecondOrderBoosting(Regressor):
    """Gradient boosting with second-order gains and leaves: ridge and lasso penalties, least child weight, depth and leaf limits, row and
    column samples, dropped trees. Missing cells go where they fit best. Row samples depend on the row's values and the seed only."""

    defaults: ClassVar[dict] = {
        "n_estimators": 100, "learning_rate": 0.3, "max_depth": 6, "max_leaves": None, "reg_alpha": 0.0, "reg_lambda": 1.0,
        "min_split_gain": 0.0, "min_child_weight": 1.0, "min_child_samples": 1, "subsample": 1.0, "subsample_freq": 1, "colsample_bytree": 1.0,
        "max_bins": 255, "objective": "squared", "boosting_type": "gbdt", "drop_rate": 0.1, "random_state": 42}
    ignored: tuple[str, ...] = ()

    def __init__(self, **params):
        dropped = [k for k in params if k in self.ignored]
        if dropped:
            warnings.warn(f"{type(self).__name__}: {dropped} have no use here; ignored", stacklevel=2)
        super().__init__(**{k: v for k, v in params.items() if k not in self.ignored})

    def settings(self) -> dict:
        return dict(self.params)

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> FittedTrees:
        o, p = self.settings(), len(features)
        if o["objective"] not in OBJECTIVES:
            raise ValueError(f"objective must be one of {sorted(OBJECTIVES)}")
        if o["boosting_type"] not in ("gbdt", "dart", "rf"):
            raise ValueError("boosting_type must be gbdt, dart or rf")
        bins, seed = int(o["max_bins"]), int(o["random_state"] or 42)
        narrow = df.select(*[F.expr(clean_double_sql(c)).alias(f"x{i}") for i, c in enumerate(features)], clean_double(target).alias("y"))
        narrow = narrow.where("y is not null")
        edges = bin_edges(narrow, [f"x{i}" for i in range(p)], bins)
        mean = narrow.agg(F.avg("y")).first()[0]
        if mean is None:
            raise ValueError("no rows to fit")
        base = math.log(max(mean, 1e-12)) if o["objective"] == "poisson" else mean
        rows = cut_lineage(spread(self._coded(narrow, edges, base, bins)))
        depth = LARGEST_DEPTH if int(o["max_depth"] or 0) <= 0 else min(int(o["max_depth"]), LARGEST_DEPTH)
        penalty = Penalty(float(o["reg_lambda"]), float(o["reg_alpha"]), float(o["min_split_gain"]), float(o["min_child_weight"]),
                          int(o["min_child_samples"]))
        freq = int(o["subsample_freq"])
        booster = Booster(penalty, edges, bins, o["objective"], depth, o["max_leaves"] and int(o["max_leaves"]), seed,
                          min(1.0, float(o["subsample"])) if freq > 0 else 1.0)
        rng = np.random.default_rng(seed)
        trees: list[Tree] = []
        weights: list[float] = []
        written = 0  # trees already in the rows' margins
        rate = float(o["learning_rate"])
        for k in range(int(o["n_estimators"])):
            chosen = sorted(rng.choice(p, max(1, min(p, round(float(o["colsample_bytree"]) * p))), replace=False).tolist())
            dropped = np.flatnonzero(rng.random(len(trees)) < float(o["drop_rate"])).tolist() if o["boosting_type"] == "dart" else []
            recent = [(t, w) for i, (t, w) in enumerate(zip(trees, weights, strict=True)) if i >= written and i not in dropped]
            tree = booster.grow(rows, [] if o["boosting_type"] == "rf" else recent, chosen, k // max(freq, 1))
            for i in dropped:
                weights[i] *= len(dropped) / (len(dropped) + 1)
            trees.append(tree)
            weights.append(rate / (len(dropped) + 1))
            if o["boosting_type"] == "gbdt" and len(trees) - written >= KEPT_TREES and k + 1 < int(o["n_estimators"]):
                after = cut_lineage(self._moved(rows, list(zip(trees[written:], weights[written:], strict=True)), p, bins))
                discard(rows)
                rows, written = after, len(trees)
        discard(rows)
        if o["boosting_type"] == "rf":
            weights = [1.0 / len(trees)] * len(trees)
        shares = tree_importances(trees, booster.gains, p)
        return FittedTrees(features, [booster.in_values(t) for t in trees], weights, base, OBJECTIVES[o["objective"]], shares)

    @staticmethod
    def _coded(narrow: DataFrame, edges: list[np.ndarray], base: float, bins: int) -> DataFrame:
        """Blocks of bin codes (``bins`` where missing), target, margin, key."""
        p, kind = len(edges), _code_kind(bins)
        keyed = narrow.select(*narrow.columns, F.xxhash64(*narrow.columns).alias("key"))

        def change(table: pa.Table) -> list[np.ndarray]:
            out = []
            for i, cuts in enumerate(edges):
                x = table.column(i).to_numpy().astype(float)
                out.append(np.where(np.isnan(x), bins, np.searchsorted(cuts, x, side="left")).astype(kind))
            return [*out, table.column(p).to_numpy(), np.full(len(table), float(base)), table.column(p + 1).to_numpy()]

        return _blocked(keyed, change, [*(f"c{i}" for i in range(p)), "y", "m", "key"])

    @staticmethod
    def _moved(rows: DataFrame, recent: list[tuple[Tree, float]], p: int, bins: int) -> DataFrame:
        held, kind = rows.sparkSession.sparkContext.broadcast(recent), _code_kind(bins)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = []
                for x, (_, margin) in _blocks([batch], p, kind, ("f8", "f8")):
                    margin = margin.copy()
                    for t, w in held.value:
                        t.added(margin, w, x, bins)
                    made.append(margin.tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:p + 1], pa.array(made, pa.binary()), batch.column(p + 2)], batch.schema.names)

        return rows.mapInArrow(run, rows.schema)


class BoostedTreesDepthwise(SecondOrderBoosting):
    """Level by level; ``gamma`` is the least gain of a split."""

    defaults: ClassVar[dict] = {**SecondOrderBoosting.defaults, "gamma": 0.0}
    ignored = ("n_jobs", "verbosity")

    def settings(self):
        return {**self.params, "min_split_gain": max(float(self.params["gamma"]), float(self.params["min_split_gain"]))}


class BoostedTreesLeafwise(SecondOrderBoosting):
    """Best leaf first, up to ``num_leaves``. Rows are sampled only if ``subsample_freq`` is above 0, anew after so many trees."""

    defaults: ClassVar[dict] = {
        **SecondOrderBoosting.defaults, "learning_rate": 0.1, "max_depth": -1, "num_leaves": 31, "min_child_samples": 20,
        "min_child_weight": 1e-3, "reg_lambda": 0.0, "subsample_freq": 0}
    ignored = ("subsample_for_bin", "n_jobs", "verbose", "verbosity")

    def settings(self):
        return {**self.params, "max_leaves": self.params["max_leaves"] or self.params["num_leaves"]}


# ---- extremely randomised trees ----------------------------------------------------------------------------------------

def drawn(seed: int, tree: int, node: int, feature: int) -> float:
    """The place of a node's cut of a feature within the range of its rows; nodes count as in a heap, the root being 1."""
    return float(mixed(np.array([node % (1 << 63)], np.uint64), seed, tree, feature)[0])


class ExtraTrees(Regressor):
    """Trees whose every node cuts each looked-at feature at one place drawn evenly between its rows' least and largest value, and takes
    the feature with the largest fall of squared error. All trees grow together, a level per two scans: ranges, then sums on both sides."""

    defaults: ClassVar[dict] = {
        "n_estimators": 100, "max_depth": 10, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": None,
        "min_impurity_decrease": 0.0, "min_weight_fraction_leaf": 0.0, "bootstrap": False, "random_state": 42}
    ignored = ("criterion", "splitter", "max_leaf_nodes", "oob_score", "ccp_alpha", "warm_start", "n_jobs", "verbose", "max_samples")

    def __init__(self, **params):
        dropped = [k for k in params if k in self.ignored]
        if dropped:
            warnings.warn(f"{type(self).__name__}: no counterpart for {dropped}; ignored", stacklevel=2)
        super().__init__(**{k: v for k, v in params.items() if k not in self.ignored})

    def _looked_at(self, p: int, tree: int, node: int) -> list[int]:
        m = self.params["max_features"]
        m = {"sqrt": math.isqrt(p), "log2": int(math.log2(p)) if p > 1 else 1, None: p, "auto": p, "all": p}.get(m, m) if not isinstance(m, float) else round(m * p)
        m = max(1, min(p, int(m)))
        order = sorted(range(p), key=lambda f: drawn(int(self.params["random_state"] or 42) + 1, tree, node, f))
        return sorted(order[:m])

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> FittedTrees:
        o, p = self.params, len(features)
        seed, n_trees = int(o["random_state"] or 42), int(o["n_estimators"])
        narrow = df.select(*[F.expr(clean_double_sql(c)).alias(f"x{i}") for i, c in enumerate(features)], clean_double(target).alias("y"))
        gaps = narrow.agg(F.count("*").alias("n"), F.sum(F.expr(" or ".join(f"{c} is null" for c in narrow.columns)).cast("int")).alias("bad")).first()
        if gaps["bad"]:
            raise ValueError("extremely randomised trees need complete rows")
        if not gaps["n"]:
            raise ValueError("no rows to fit")
        keyed = narrow.select(*narrow.columns, F.xxhash64(*narrow.columns).alias("key"))
        rows = cut_lineage(spread(_blocked(keyed, lambda table: [c.to_numpy() for c in table.columns], keyed.columns)))
        least = max(int(o["min_samples_leaf"]), math.ceil(float(o["min_weight_fraction_leaf"]) * gaps["n"]), 1)
        depth = LARGEST_DEPTH if o["max_depth"] is None else min(int(o["max_depth"]), LARGEST_DEPTH)
        grown: list[list[list]] = [[[-1, 0.0, -1, -1, 0.0, 0.0, 1]] for _ in range(n_trees)]  # feature, cut, left, right, mean, rows, heap number
        gains: list[list[float]] = [[0.0] for _ in range(n_trees)]
        frontier = [(t, 0) for t in range(n_trees)]
        for _ in range(depth):
            if not frontier:
                break
            ranges = self._scan(rows, grown, frontier, None, p, seed)
            cuts: dict[tuple[int, int], dict[int, float]] = {}
            for (t, node), (low, high) in ranges.items():
                number = grown[t][node][6]
                looked = {f: low[f] + drawn(seed, t, number, f) * (high[f] - low[f]) for f in self._looked_at(p, t, number) if high[f] > low[f]}
                if looked:
                    cuts[t, node] = looked
            after = []
            for (t, node), (gain, f, cut, n, mean, n_left, mean_left) in self._scan(rows, grown, sorted(cuts), cuts, p, seed, least).items():
                row = grown[t][node]
                row[4], row[5] = mean, n
                if n < int(o["min_samples_split"]) or gain is None or gain / gaps["n"] < float(o["min_impurity_decrease"]) or gain <= 0:
                    continue
                left, right = len(grown[t]), len(grown[t]) + 1
                row[:4] = [f, cut, left, right]
                gains[t][node] = gain
                mean_right = (n * mean - n_left * mean_left) / (n - n_left)
                grown[t] += [[-1, 0.0, -1, -1, mean_left, n_left, 2 * row[6]], [-1, 0.0, -1, -1, mean_right, n - n_left, 2 * row[6] + 1]]
                gains[t] += [0.0, 0.0]
                after += [(t, left), (t, right)]
            frontier = after
        discard(rows)
        whole = narrow.agg(F.avg("y")).first()[0]
        for t in grown:
            if t[0][5] == 0.0:  # nothing could be cut
                t[0][4], t[0][5] = whole, float(gaps["n"])
        trees = [Tree.of([(*r[:5], False, r[5]) for r in t]) for t in grown]
        shares = tree_importances(trees, [np.array(g) for g in gains], p)
        return FittedTrees(features, trees, [1.0 / n_trees] * n_trees, 0.0, importances=shares)

    def _scan(self, rows: DataFrame, grown, frontier, cuts, p: int, seed: int, least: int = 1) -> dict:
        """By (tree, node) of the frontier: ranges of all features (``cuts`` None), or the best of the drawn cuts."""
        slots = {key: k for k, key in enumerate(frontier)}
        per_tree: dict[int, tuple[Tree, np.ndarray]] = {}
        for t in {t for t, _ in frontier}:
            tree = Tree.of([(*r[:5], False, r[5]) for r in grown[t]])
            per_tree[t] = tree, np.array([slots.get((t, k), -1) for k in range(len(grown[t]))])
        bounds = np.full((len(frontier), p), np.nan)
        for key, looked in (cuts or {}).items():
            for f, c in looked.items():
                bounds[slots[key], f] = c
        held = rows.sparkSession.sparkContext.broadcast((per_tree, bounds))
        weighted, size, ranging = bool(self.params["bootstrap"]), len(frontier), cuts is None
        rows = rows.select(*[c for c in rows.columns if c != "key" or weighted])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, bound = held.value
            low, high = np.full((size, p), np.inf), np.full((size, p), -np.inf)
            left, whole = np.zeros((size, p, 3)), np.zeros((size, 3))
            for x, (y, *keys) in _blocks(batches, p, "f8", ("f8", "i8")):
                for t, (tree, slot_of) in trees.items():
                    w = _times(mixed(keys[0], seed, 7, t)) if weighted else None
                    for s, use in tree.parted(x, slot_of):
                        if weighted and not len(use := use[w[use] > 0]):
                            continue
                        if ranging:
                            for f in range(p):
                                v = x[f][use]
                                low[s, f], high[s, f] = min(low[s, f], v.min()), max(high[s, f], v.max())
                            continue
                        seen = y[use]
                        parts = (w[use], w[use] * seen, w[use] * seen ** 2) if weighted else (np.ones(len(use)), seen, seen ** 2)
                        parts = np.column_stack(parts)
                        whole[s] += parts.sum(axis=0)
                        for f in np.flatnonzero(~np.isnan(bound[s])):
                            left[s, f] += (x[f][use] <= bound[s, f]) @ parts
            if ranging:
                k, f = np.nonzero(low <= high)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f), pa.array(low[k, f]), pa.array(high[k, f])], ["k", "f", "low", "high"])
            else:
                k, f = np.nonzero(~np.isnan(bound) & (whole[:, :1] > 0))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f), *(pa.array(left[k, f, i]) for i in range(3)), *(pa.array(whole[k, i]) for i in range(3))],
                                                 ["k", "f", "a", "b", "c", "n", "s", "q"])

        out: dict = {}
        if ranging:
            for r in rows.mapInArrow(run, "k long, f long, low double, high double").groupBy("k", "f").agg(F.min("low"), F.max("high")).collect():
                low, high = out.setdefault(frontier[r["k"]], (np.zeros(p), np.zeros(p)))
                low[r["f"]], high[r["f"]] = r[2], r[3]
            return out
        got = rows.mapInArrow(run, "k long, f long, a double, b double, c double, n double, s double, q double").groupBy("k", "f").agg(
            *[F.sum(c).alias(c) for c in "abcnsq"])
        right, right_sum = F.col("n") - F.col("a"), F.col("s") - F.col("b")
        gain = F.when((F.col("a") >= least) & (right >= least), F.col("b") * F.col("b") / F.col("a") + right_sum * right_sum / right
                      - F.col("s") * F.col("s") / F.col("n"))
        best = got.groupBy("k").agg(F.max(F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), "a", "b")).alias("best"), F.max("n").alias("n"),
                                    F.max("s").alias("s"), F.min("s").alias("s0"))
        for r in best.collect():  # one row per node
            key, b = frontier[r["k"]], r["best"]
            f = -b["f"]
            mean_left = b["b"] / b["a"] if b["a"] else 0.0
            out[key] = (b["gain"], f, float(bounds[r["k"], f]), r["n"], r["s"] / r["n"], b["a"], mean_left)
        return out


def _times(u: np.ndarray) -> np.ndarray:
    """How often a row is drawn (Poisson with mean 1) by an even number."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(steps, u, side="right").astype(float)


class ExtraTree(ExtraTrees):
    """One such tree."""

    defaults: ClassVar[dict] = {**ExtraTrees.defaults, "n_estimators": 1}
