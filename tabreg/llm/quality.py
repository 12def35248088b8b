"""Quality scores: random Fourier features of document statistics, ridge from partition-summed normal equations, isotonic
calibration of out-of-fold scores.

Every whole text is read once for its statistics. At most about ``SAMPLE`` labelled rows outside the held-out fold are used
to fit (a bound on the fit alone; all documents are scored). Each task sends one sum of outer products per fold; a fold's
out-of-fold weights come from the other folds' sums, so choosing the ridge strength needs no further pass.

Inputs of a score are statistics of the text only. NULL text counts as empty and is scored like it. Repeated rows are scored
alike; repeated labels of an id agree by the largest. Without usable labels of both classes every score is the labels' mean
(0.5 if there are none). Only id and text (and the label columns) are read from the input tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.llm.common import crc_fold, cut_lineage, discard, narrow, pieces_of_batches, train_rows

SAMPLE = 60_000
FEATURES = 192
SEED = 20240611
RIDGE = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
BINS = 1024
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.int64)  # 0: part of a character beyond ASCII
for _name, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\f\v", "\n",
                                ".,;:'\"()-", "!?", "|", "%&$#*@^~<>=+/\\_{}[]`"), start=1):
    for _c in _chars:
        _CLASS[ord(_c)] = _name
CLASSES = 10
STATISTICS = CLASSES - 1 + 11


def statistics(texts: list[str]) -> np.ndarray:
    """One row of numbers per text."""
    out = np.zeros((len(texts), STATISTICS))
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        count = np.bincount(_CLASS[raw], minlength=CLASSES) if len(raw) else np.zeros(CLASSES)
        words = text.split()
        lines = [x for x in text.split("\n") if x]
        n, w = max(1, len(raw)), max(1, len(words))
        letters = max(1, count[0] / 2 + count[1] + count[2])
        sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        different = len(set(words))
        out[k, : CLASSES - 1] = np.sqrt(count[1:] / n)
        out[k, CLASSES - 1:] = (
            np.log1p(len(raw)), np.log1p(len(words)), sizes.mean() / 8, sizes.std() / 8, np.log1p(sizes.max()),
            different / w, np.log1p(different) / np.log1p(w), len(set(lines)) / max(1, len(lines)),
            np.log1p(len(words) / max(1, len(lines))), count[1] / letters, (sizes <= 3).mean())
    return out


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, f array<double>) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of_batches(batches, "text"):
            f = statistics([t or "" for t in batch.column(1).to_pylist()])
            ends = pa.array(np.arange(0, f.size + 1, STATISTICS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(f.ravel()))],
                                             ["doc_id", "f"])

    rows = narrow(docs, doc_id=f"{id_column}:long", text=f"{text_column}:string")
    return rows.mapInArrow(run, "doc_id long, f array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    base: float

    def features(self, f: np.ndarray) -> np.ndarray:
        """Cosines whose products approximate a Gaussian kernel of the scaled statistics; the last column is 1."""
        rng = np.random.default_rng(SEED)
        frequency = rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS / 2)
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((f - self.mean) / self.scale, -6, 6)
        return np.c_[np.sqrt(2 / FEATURES) * np.cos(x @ frequency + phase), np.ones(len(f))]

    def score(self, f: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(f), self.base)
        raw = self.features(f) @ self.weights
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(0.998 * level + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)  # the last term only breaks ties


def _sums(rows: DataFrame, model: QualityModel) -> dict[int, tuple[np.ndarray, np.ndarray, float, int]]:
    """Per fold: Z'Z, Z'y, y'y and the count, summed over the partitions' sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            f = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, STATISTICS)
            y, fold = (np.array(batch.column(k).to_pylist(), dtype=float) for k in (1, 2))
            z = model.features(f)
            for k in np.unique(fold):
                own, target = z[fold == k], y[fold == k]
                part = [own.T @ own, own.T @ target, target @ target, len(target)]
                have = total.get(int(k))
                total[int(k)] = part if have is None else [a + b for a, b in zip(have, part, strict=True)]
        for k, (a, b, yy, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([a.tobytes()]), pa.array([b.tobytes()]), pa.array([float(yy)]),
                                              pa.array([n])], ["fold", "a", "b", "yy", "n"])

    out: dict[int, tuple] = {}
    for r in rows.select("f", "label", "fold").mapInArrow(run, "fold long, a binary, b binary, yy double, n long").collect():
        a, b = np.frombuffer(r["a"]).reshape(FEATURES + 1, -1), np.frombuffer(r["b"])
        have = out.get(r["fold"], (0, 0, 0, 0))
        out[r["fold"]] = (have[0] + a, have[1] + b, have[2] + r["yy"], have[3] + r["n"])
    return out


def _solve(a: np.ndarray, b: np.ndarray, n: int, ridge: float) -> np.ndarray:
    penalty = np.full(len(b), ridge * n)
    penalty[-1] = 1e-9 * n
    return np.linalg.solve(a + np.diag(penalty), b)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing weighted least-squares fit: neighbours out of order are pooled."""
    pools: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def sampled_labels(labels: DataFrame, value: str, limit: int = SAMPLE) -> DataFrame:
    """Training labels, thinned by a hash of the id to about ``limit`` rows where there are more; small enough to broadcast."""
    rows = train_rows(labels, value)
    n = rows.count()
    if n > limit:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 20)) < int(limit / n * (1 << 20)))
    return rows


def fit_quality(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """``stats`` as from ``document_statistics``; ``labels`` with doc_id and quality."""
    known = sampled_labels(labels, "quality", sample).withColumnRenamed("doc_id", "__id")
    rows = cut_lineage(stats.join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
                       .select("f", F.col("label").cast("double").alias("label"), crc_fold(F.col("doc_id")).alias("fold"))
                       .repartition(16))
    cells = [F.col("f")[i] for i in range(STATISTICS)]
    at = rows.agg(F.count("*").alias("n"), F.avg("label").alias("base"), F.array(*[F.avg(c) for c in cells]).alias("mean"),
                  F.array(*[F.stddev_pop(c) for c in cells]).alias("sd")).collect()[0]
    none = np.empty(0)
    if not at["n"] or at["base"] in (0.0, 1.0):
        discard(rows)
        return QualityModel(none, none, none, none, none, 0.5 if at["base"] is None else at["base"])
    sd = np.array(at["sd"])
    model = QualityModel(np.array(at["mean"]), np.where(sd > 1e-9, sd, 1.0), none, none, none, at["base"])
    sums = _sums(rows, model)
    whole = [sum(s[k] for s in sums.values()) for k in range(4)]

    def outside(fold: int, ridge: float) -> np.ndarray:
        own = sums.get(fold, (0, 0, 0, 0))
        rest = [whole[k] - own[k] for k in range(4)] if len(sums) > 1 else whole
        return _solve(rest[0], rest[1], max(1, rest[3]), ridge)

    def error(ridge: float) -> float:
        return sum(s[2] - 2 * (w := outside(k, ridge)) @ s[1] + w @ s[0] @ w for k, s in sums.items())

    ridge = min(RIDGE, key=error)
    fold_weights = {k: outside(k, ridge) for k in sums}

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, ones = np.zeros(BINS, np.int64), np.zeros(BINS)
        for batch in batches:
            z = model.features(np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, STATISTICS))
            y, fold = (np.array(batch.column(k).to_pylist(), dtype=float) for k in (1, 2))
            raw = np.array([row @ fold_weights[int(k)] for row, k in zip(z, fold, strict=True)])
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            count += np.bincount(at, minlength=BINS)
            ones += np.bincount(at, weights=y, minlength=BINS)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen]), pa.array(ones[seen])], ["bin", "n", "ones"])

    bins = (rows.select("f", "label", "fold").mapInArrow(binned, "bin long, n long, ones double").groupBy("bin")
            .agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("bin").collect())
    discard(rows)
    n, ones = np.array([r["n"] for r in bins], float), np.array([r["ones"] for r in bins])
    model.weights = _solve(whole[0], whole[1], whole[3], ridge)
    model.knots = (np.array([r["bin"] for r in bins]) + 0.5) / BINS * 2 - 0.5
    model.levels = isotonic((ones + model.base * 0.01) / (n + 0.01), n)
    return model


def score_column(model: QualityModel, text: Column) -> Column:
    """Score of a text column inside any query."""

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics([v if isinstance(v, str) else "" for v in values])))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by a model of the labels outside the held-out fold."""
    stats = cut_lineage(document_statistics(docs))
    model = fit_quality(stats, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(1).flatten().to_numpy().reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(f))], ["doc_id", "score"])

    scored = stats.select("doc_id", "f").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their own columns."""
    model = fit_quality(document_statistics(docs), labels)
    return docs.filter(score_column(model, F.col("text").cast("string")) >= THRESHOLD)
