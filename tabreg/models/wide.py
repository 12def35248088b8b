"""Ridge regression on text columns with any number of values, by their sparse Gram and conjugate gradients.

Places of the Gram: 0 is the constant, then the numeric columns about their means, then the values of the text columns.
Tasks multiply their Arrow batches block by block (numbers with numbers, values with numbers, values with values), so a
row costs its own columns and not the number of values.  Gram, right side and search directions are tables; the driver
holds two sums per round and the coefficients of the numeric columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double_sql, is_numeric, q
from tabreg.models.base import PREDICTION, Fitted, Regressor, linear_expression
from tabreg.models.gram import MAX_FEATURES, column_shift
from tabreg.operators.encode import attach_codes
from tabreg.operators.sparse import SparseDummies, fit_sparse_dummies
from tabreg.sources.storage import cut_lineage, discard

SIDE = -1                      # second index of the sums with the target
SMALL_DIRECTION = 1_000_000    # places of a direction that are broadcast (16 bytes each)


def _cells(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v, pa.float64())], names=["i", "j", "v"])


def sparse_gram(df: DataFrame, numeric: Sequence[str], dummies: SparseDummies, target: str, centre: np.ndarray) -> DataFrame:
    """(i, j, v): sums over rows of products of two places, i <= j, and with the target (j = SIDE)."""
    p, k, width = len(numeric), len(dummies.tables), dummies.width
    view = dummies.with_places(df).select(
        *[F.expr(clean_double_sql(c)).alias(f"x{i}") for i, c in enumerate((*numeric, target))],
        *[F.coalesce(c, F.lit(-1)).cast("long").alias(f"c{i}") for i, c in enumerate(dummies.places())])
    upper = np.triu_indices(p + 1)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, side = np.zeros((p + 1, p + 1)), np.zeros(p + 1)
        for batch in batches:
            z = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(p + 1)]) - centre
            if np.isnan(z).any():
                raise ValueError("missing cells: impute before fitting")
            codes = [batch.column(p + 1 + i).to_numpy(zero_copy_only=False) for i in range(k)]
            z = np.column_stack([np.ones(len(z)), z])
            square += z[:, :p + 1].T @ z[:, :p + 1]
            side += z[:, :p + 1].T @ z[:, p + 1]
            for a in range(k):
                order = np.argsort(codes[a], kind="stable")
                order = order[np.searchsorted(codes[a][order], 0):]
                if not len(order):
                    continue
                level, first, count = np.unique(codes[a][order], return_index=True, return_counts=True)
                sums = np.add.reduceat(z[order], first, axis=0)
                place = level + p + 1
                yield _cells(np.tile(np.arange(p + 1), len(place)), np.repeat(place, p + 1), sums[:, :p + 1].ravel())
                yield _cells(place, np.full(len(place), SIDE), sums[:, p + 1])
                yield _cells(place, place, count.astype(float))
                for b in range(a + 1, k):
                    both = (codes[a] >= 0) & (codes[b] >= 0)
                    pair, count = np.unique(codes[a][both] * width + codes[b][both], return_counts=True)
                    yield _cells(pair // width + p + 1, pair % width + p + 1, count.astype(float))
        yield _cells(upper[0], upper[1], square[upper])
        yield _cells(np.arange(p + 1), np.full(p + 1, SIDE), side)

    return view.mapInArrow(multiply, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def _times(gram: DataFrame, state: DataFrame, dense: int, width: int) -> DataFrame:
    """(i, q): Gram times direction.  Numeric places own whole rows of the Gram: their few entries are broadcast, and so is a
    direction of up to SMALL_DIRECTION places; a longer one meets the remaining cells in a shuffle."""
    entry = state.select(F.col("i").alias("j"), "p")
    if width <= SMALL_DIRECTION:
        products = gram.join(F.broadcast(entry), "j")
    else:
        products = (gram.where(F.col("j") < dense).join(F.broadcast(entry.where(F.col("j") < dense)), "j")
                    .unionByName(gram.where(F.col("j") >= dense).join(entry.where(F.col("j") >= dense), "j")))
    return products.groupBy("i").agg(F.sum(F.col("v") * F.col("p")).alias("g"))


def conjugate_gradients(cells: DataFrame, alpha: float, dense: int, width: int, max_iter: int, tol: float) -> tuple[DataFrame, dict]:
    """(i, x) with (G + alpha on all places but the constant) x = right side, preconditioned by the diagonal.

    Ends when the preconditioned residual is ``tol`` of the first one.  Every round is one written table."""
    square = cells.where(F.col("j") != SIDE)
    gram = cut_lineage(square.unionByName(square.where(F.col("i") < F.col("j")).select(F.col("j").alias("i"), F.col("i").alias("j"), "v")))
    penalty = F.when(F.col("i") == 0, 0.0).otherwise(float(alpha))
    diagonal = gram.where(F.col("i") == F.col("j")).select("i", (F.col("v") + penalty).alias("d"))
    side = cells.where(F.col("j") == SIDE).select("i", F.col("v").alias("b"))
    scaled = F.when(F.col("d") > 0, F.col("r") / F.col("d")).otherwise(0.0)
    last = cut_lineage(diagonal.join(side, "i").select("i", "d", F.lit(0.0).alias("x"), F.col("b").alias("r")))
    state = last.withColumn("p", scaled)
    size = first = state.agg(F.sum(F.col("r") * scaled)).first()[0] or 0.0
    rounds = 0
    while rounds < max_iter and size > tol * tol * first:
        rounds += 1
        step = cut_lineage(state.join(_times(gram, state, dense, width), "i", "left")
                           .withColumn("g", F.coalesce("g", F.lit(0.0)) + penalty * F.col("p")))
        discard(last)
        last, state = step, step.drop("g")
        curve = step.agg(F.sum(F.col("p") * F.col("g"))).first()[0]
        if not curve > 0:
            break
        a = size / curve
        moved = step.select("i", "d", (F.col("x") + a * F.col("p")).alias("x"), (F.col("r") - a * F.col("g")).alias("r"), "p")
        before, size = size, moved.agg(F.sum(F.col("r") * scaled)).first()[0]
        state = moved.withColumn("p", scaled + (size / before) * F.col("p"))
    solved = cut_lineage(state.select("i", "x"))
    discard(last)
    discard(gram)
    return solved, {"rounds": rounds, "residual": float(np.sqrt(size / first)) if first > 0 else 0.0}


class FittedWide(Fitted):
    """Coefficients of numeric columns on the driver, those of the text columns' values in tables (value, code, rows)."""

    def __init__(self, numeric: Sequence[str], coef: Sequence[float], intercept: float, tables: dict[str, DataFrame],
                 totals: dict[str, tuple[int, int]], info: dict | None = None):
        self.numeric, self.coef, self.intercept = list(numeric), [float(b) for b in coef], float(intercept)
        self.tables, self.totals, self.info = tables, totals, info or {}
        self.features = [*self.numeric, *tables]

    def predict(self, df: DataFrame, name: str = PREDICTION) -> DataFrame:
        """A missing or unseen value adds nothing."""
        order = df.columns
        for i, (c, table) in enumerate(self.tables.items()):
            df = attach_codes(df, c, table, f"__effect{i}", *self.totals[c])
        total = linear_expression(self.numeric, self.coef, self.intercept)
        for i in range(len(self.tables)):
            total = total + F.coalesce(F.col(f"__effect{i}"), F.lit(0.0))
        return df.select(*[q(c) for c in order if c != name], total.alias(name))


class WideRidge(Regressor):
    """Ridge on numeric and text features; text needs no encoding first and may hold any number of values."""

    defaults = {"alpha": 1.0, "drop_first": False, "max_iter": 500, "tol": 1e-10}

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> FittedWide:
        o = self.params
        numeric = [c for c in features if is_numeric(df.schema[c].dataType)]
        texts = [c for c in features if c not in numeric]
        if len(numeric) > MAX_FEATURES:
            raise ValueError(f"more than {MAX_FEATURES} numeric features: select or reduce them first")
        dummies = fit_sparse_dummies(df, texts, o["drop_first"])
        centre, p, width = column_shift(df, numeric, target), len(numeric), dummies.width
        cells = cut_lineage(sparse_gram(df, numeric, dummies, target, centre))
        if cells.where("i = 0 AND j = 0 AND v > 0").isEmpty():
            raise ValueError("no rows to fit")
        solved, info = conjugate_gradients(cells, o["alpha"], p + 1, p + 1 + width, int(o["max_iter"]), o["tol"])
        head = {r["i"]: r["x"] for r in solved.where(F.col("i") <= p).select("i", "x").collect()}
        coef = np.array([head[i + 1] for i in range(p)])
        tables = {}
        for c in texts:
            at = dummies.offsets[c] + p + 1 - int(o["drop_first"])
            effect = solved.select((F.col("i") - at).alias("code"), "x")
            tables[c] = cut_lineage(dummies.tables[c].where(F.col("code") >= int(o["drop_first"])).join(effect, "code")
                                    .select("value", F.col("x").alias("code"), "rows"))
            discard(dummies.tables[c])
        discard(cells)
        discard(solved)
        return FittedWide(numeric, coef, head[0] + centre[p] - coef @ centre[:p], tables, dummies.totals, info)
