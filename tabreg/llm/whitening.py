"""Embedding whitening with an exact covariance from bit-sliced cross-products.

Every entry becomes an integer, x = floor(1024 * entry) + 100000. A task takes some thousand rows at a time, shifts each dimension to
start at 0, and packs every bit plane of every dimension across the rows into 64-bit words. The population count of the AND of two planes,
weighted by both planes' powers of two, adds up to the exact cross-product of two dimensions; the shift is undone in whole numbers.
Sums travel as 30-bit limbs, so Spark's sums of longs are exact too. One row per pair of dimensions reaches the driver, where
n * sum(x x') - S S' is formed in whole numbers, divided by n squared, and decomposed by eigh.

Rows: a vector that is NULL, or holds NULL, NaN or infinite entries (or entries beyond 2 ** 51), is left out, as is one whose length is not
the commonest (of equally common ones the longest). Repeated and NULL ids stay, one result each. Components without variance (up to
rounding) give no rows, so a single vector, or equal ones, give none; an empty table gives none. A deviation beyond a long is NULL.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm.common import narrow

SCALE, OFFSET = 1024, 100_000
ROWS = 8_192           # packed at a time
CELLS = 1 << 21        # entries of rows held at a time
LIMB, LIMBS = 30, 5
LARGEST = float(1 << 51)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _blocks(batches: Iterable[pa.RecordBatch], length: int | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers (rows x dimensions) of the usable vectors of one length, or of each length (None)."""
    for batch in batches:
        vectors = batch.column(1)
        sizes = np.asarray(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
        for d in [length] if length is not None else np.unique(sizes[sizes >= 0]).tolist():
            mine = np.flatnonzero(sizes == d)
            step = max(1, min(ROWS, CELLS // max(d, 1)))
            for start in range(0, len(mine), step):
                at = pa.array(mine[start:start + step])
                flat = vectors.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)  # NULL entries are NaN
                good = (np.abs(flat) <= LARGEST).all(axis=1)
                if good.any():
                    yield batch.column(0).take(at.filter(pa.array(good))), np.floor(flat[good] * SCALE).astype(np.int64) + OFFSET


def _lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[int, int] = {}
    for _, x in _blocks(batches, None):
        count[x.shape[1]] = count.get(x.shape[1], 0) + len(x)
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], ["d", "n"])


# ---- bit slices --------------------------------------------------------------------------------------------------------

def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole numbers >= 0 (rows x dimensions): planes (plane x word, rows packed), each plane's dimension and bit; empty ones left out."""
    rows, d = y.shape
    tops = [int(v).bit_length() for v in y.max(axis=0)]
    planes, dims, bits = [], [], []
    padded = np.zeros((d, -(-rows // 64) * 64), np.uint8)
    for b in range(max(tops, default=0)):
        padded[:, :rows] = ((y >> b) & 1).T
        have = np.flatnonzero(padded.any(axis=1))
        planes.append(np.packbits(padded[have], axis=1).view(np.uint64))
        dims.append(have)
        bits.append(np.full(len(have), b))
    if not planes:
        return np.empty((0, 1), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    dim, bit = np.concatenate(dims), np.concatenate(bits)
    by = np.lexsort((bit, dim))
    return np.concatenate(planes)[by], dim[by], bit[by]


def cross_products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of every dimension, and cross-products of every pair of dimensions (upper triangle), as Python's whole numbers."""
    d = y.shape[1]
    planes, dim, bit = bit_planes(y)
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    if not len(dim):
        return sums, products
    np.add.at(sums, dim, np.bitwise_count(planes).sum(axis=1, dtype=np.int64).astype(object) * (1 << bit.astype(object)))
    wide = 2 * int(bit.max()) + len(y).bit_length() + 14 > 62
    weight = (1 << bit.astype(object)) if wide else (np.int64(1) << bit)
    first = np.flatnonzero(np.r_[True, dim[1:] != dim[:-1]])
    total = np.zeros((d, d), object if wide else np.int64)
    for k in range(len(dim)):
        start = first[np.searchsorted(first, k, side="right") - 1]  # all planes of this dimension and later ones
        both = np.bitwise_count(planes[start:] & planes[k]).sum(axis=1, dtype=np.int64)
        groups = first[first >= start]
        total[dim[k], dim[groups]] += weight[k] * np.add.reduceat(both * weight[start:], groups - start)
    return sums, total.astype(object)


@dataclass
class Moments:
    """Exact count, sums and cross-products (upper triangle) of whole numbers."""

    n: int
    sums: np.ndarray
    products: np.ndarray

    @staticmethod
    def none(d: int) -> Moments:
        return Moments(0, np.zeros(d, object), np.zeros((d, d), object))

    def add(self, x: np.ndarray) -> None:
        low = x.min(axis=0)
        sums, products = cross_products(x - low)
        shift, n = low.astype(object), len(x)
        self.n += n
        self.sums = self.sums + sums + n * shift
        self.products = self.products + products + np.outer(shift, sums) + np.outer(sums, shift) + n * np.outer(shift, shift)


def _limbs(v: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


@dataclass
class Whitener:
    """What the rows need: n, sums, components (dimension x component) over the square root of their variance, and shares."""

    n: int
    sums: np.ndarray
    turn: np.ndarray
    explained: np.ndarray

    @staticmethod
    def of(moments: Moments, components: int) -> Whitener:
        n, d = moments.n, len(moments.sums)
        upper = np.triu_indices(d)
        v = np.zeros((d, d))
        exact = n * moments.products[upper] - moments.sums[upper[0]] * moments.sums[upper[1]]
        v[upper] = [int(c) / (n * n) for c in exact] if n else 0.0
        v = v + np.triu(v, 1).T
        values, vectors = np.linalg.eigh(v) if d else (np.empty(0), np.empty((0, 0)))
        values, vectors = values[::-1], vectors[:, ::-1]
        k = min(components, int((values > d * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)).sum()))
        vectors = vectors[:, :k]
        sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)]) if k else np.empty(0)
        return Whitener(n, moments.sums, vectors * sign / np.sqrt(values[:k]), values[:k] / np.trace(v) if k else np.empty(0))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in whole numbers."""
        most = self.n * max(int(np.abs(x).max()), 1) + max((abs(int(s)) for s in self.sums), default=0)
        return self.n * (x if most < 1 << 62 else x.astype(object)) - (self.sums.astype(np.int64) if most < 1 << 62 else self.sums)

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened rows, and each row's deviation."""
        gap = self.centred(x)
        wide = gap.dtype == object or int(np.abs(gap).max()) ** 2 * x.shape[1] >= 1 << 63
        square = ((gap.astype(object) if wide else gap) ** 2).sum(axis=1).tolist()
        return (gap / self.n).astype(np.float64) @ self.turn, [s if s < 1 << 63 else None for s in square]


def exact_moments(vectors: DataFrame, d: int) -> Moments:
    """Of all usable rows of (vec_id, vector)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Moments.none(d)
        for _, x in _blocks(batches, d):
            got.add(x)
        if got.n:
            i, j = np.triu_indices(d)
            values = [*got.products[i, j].tolist(), *got.sums.tolist(), got.n]
            limbs = np.array([_limbs(int(v)) for v in values], np.int64)
            at = [np.r_[i, np.arange(d), d], np.r_[j, np.full(d, d), d]]  # column d: sums; (d, d): n
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (*at, *limbs.T)], ["i", "j", *(f"l{k}" for k in range(LIMBS))])

    names = [f"l{k}" for k in range(LIMBS)]
    parts = vectors.mapInArrow(run, ", ".join(f"{c} long" for c in ("i", "j", *names)))
    out = Moments.none(d)
    for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).collect():  # one row per pair of dimensions
        v = sum(r[c] << (LIMB * k) for k, c in enumerate(names))
        if r["i"] == d:
            out.n = v
        elif r["j"] == d:
            out.sums[r["i"]] = v
        else:
            out.products[r["i"], r["j"]] = v
    return out


def identity_error(vectors: DataFrame, d: int, fit: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k = fit.turn.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, d):
            w = fit.rows(x)[0]
            total += w.sum(axis=0)
            square += w.T @ w
        flat = np.r_[total, square.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "v"])

    got = np.zeros(k + k * k)
    for r in vectors.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        got[r["at"]] = r["v"]
    mean = got[:k] / fit.n
    return float(np.abs(got[k:].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(df: DataFrame, components: int = 8, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per usable vector and component (numbered from 1 by falling variance): vec_id, component, n, deviation (sum over dimensions
    of (n * x - S) ** 2), whitened, explained, identity_error."""
    vectors = narrow(df, vec_id=f"{id_column}:long", vector=f"{vector_column}:array<double>")
    lengths = vectors.mapInArrow(_lengths, "d long, n long").groupBy("d").agg(F.sum("n").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    none = df.sparkSession.createDataFrame([], RESULT)
    if common is None:
        return none
    d = common["d"]
    fit = Whitener.of(exact_moments(vectors, d), components)
    k = fit.turn.shape[1]
    if not k:
        return none
    error = identity_error(vectors, d, fit)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, d):
            white, deviation = fit.rows(x)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, fit.n)),
                 pa.array(deviation, pa.int64()).take(each), pa.array(white.ravel()), pa.array(np.tile(fit.explained, len(x))),
                 pa.array(np.full(m, error))], [c.split()[0] for c in RESULT.split(", ")])

    return vectors.mapInArrow(run, RESULT)
