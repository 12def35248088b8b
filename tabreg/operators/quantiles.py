"""Exact interpolated quantiles without holding a column in one buffer.

``percentile`` keeps every distinct value of a group in one aggregation buffer, and one sketch over a
huge table meets all partial sketches in one task.  Here up to LIMIT values are counted one by one.
Beyond that, salted sketches (SALTS small merges instead of one big one) bracket each wanted rank, the
rows below the bracket are counted as one number, and the bracket is narrowed scan by scan until it
is small enough to count.  Every bracket is checked to hold its rank: the answer is exact or the job
fails.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabreg.functions.columns import clean_double, clean_double_sql
from tabreg.sources.storage import cut_lineage

LIMIT = 2_000_000
SALTS = 200
POINTS = 1_000
ACCURACY = 4_000
ROUNDS = 6


def _margin() -> float:
    """Largest rank error of the combined sketches, doubled."""
    return 2.0 * (1.0 / POINTS + 1.0 / ACCURACY)


def _points() -> Column:
    return F.expr(f"array({', '.join(f'{(k + 0.5) / POINTS!r}D' for k in range(POINTS))})")


def _salt() -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(SALTS))


def _between_ranks(cum: DataFrame, keys: list[str]) -> DataFrame:
    """cum: keys, v, cum (rows up to v), rank.  Linear interpolation between the two nearest rows."""
    ends = cum.groupBy(*keys).agg(
        F.min(F.when(F.col("cum") > F.floor("rank"), F.col("v"))).alias("a"),
        F.min(F.when(F.col("cum") > F.ceil("rank"), F.col("v"))).alias("b"),
        F.max("cum").alias("top"), F.first("rank").alias("rank"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(
        F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank")))
    held = F.col("top") > F.ceil("rank")
    return ends.select(*keys, F.when(held, value).otherwise(
        F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")).alias("value"))


def _running(keys: list[str]):
    return F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns of one table; a handful of numbers come back."""
    cols, qs = list(dict.fromkeys(cols)), [float(p) for p in qs]
    out: dict[str, list[float | None]] = {c: [None] * len(qs) for c in cols}
    if not cols:
        return out
    row = df.agg(*[F.expr(f"count({clean_double_sql(c)}) AS n{i}") for i, c in enumerate(cols)]).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    few = [c for c in cols if 0 < sizes[c] <= LIMIT]
    if few:
        cells = F.array(*[F.expr(f"named_struct('slot', {i}, 'v', {clean_double_sql(c)})") for i, c in enumerate(few)])
        counted = (df.select(F.inline(cells)).where(F.col("v").isNotNull())
                   .groupBy("slot", "v").agg(F.count(F.lit(1)).alias("c")))
        wanted = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(p).alias("p")) for j, p in enumerate(qs)]))
        total = F.get(F.array(*[F.lit(sizes[c]).cast("long") for c in few]), F.col("slot"))
        cum = (counted.withColumn("cum", _running(["slot"])).select("slot", "v", "cum", wanted.alias("q"))
               .select("slot", "v", "cum", F.col("q.j").alias("j"), (F.col("q.p") * (total - 1)).alias("rank")))
        for r in _between_ranks(cum, ["slot", "j"]).collect():
            out[few[r["slot"]]][r["j"]] = r["value"]
    for c in cols:
        if sizes[c] > LIMIT:
            out[c] = _wide_column(df, c, sizes[c], qs)
    return out


def _wide_column(df: DataFrame, col: str, n: int, qs: list[float]) -> list[float]:
    """Ranks of one column too large to count value by value."""
    v = clean_double(col)
    inf = float("inf")
    slots = [{"rank": p * (n - 1), "lo": -inf, "hi": inf, "below": 0, "inside": n} for p in qs]
    for _ in range(ROUNDS):
        work = [s for s in slots if s["inside"] > LIMIT and s["lo"] < s["hi"] and not s.get("stuck")]
        if not work:
            break
        ranges = list(dict.fromkeys((s["lo"], s["hi"]) for s in work))
        inside = [F.when(v.between(lo, hi), v) for lo, hi in ranges]
        parts = df.groupBy(_salt().alias("salt")).agg(*[e for i, x in enumerate(inside) for e in (
            F.count(x).alias(f"n{i}"), F.percentile_approx(x, _points(), ACCURACY).alias(f"p{i}"))]).collect()
        found = []
        for s in work:
            i = ranges.index((s["lo"], s["hi"]))
            points = np.concatenate([np.asarray(r[f"p{i}"]) for r in parts if r[f"n{i}"]])
            weight = np.concatenate([np.full(POINTS, r[f"n{i}"] / POINTS) for r in parts if r[f"n{i}"]])
            order = np.argsort(points, kind="stable")
            points, reach = points[order], np.cumsum(weight[order])
            at, slack = s["rank"] - s["below"], _margin() * s["inside"] + 2
            low = np.searchsorted(reach, at - slack, "right") - 1
            high = np.searchsorted(reach, at + slack, "left")
            found.append((float(points[low]) if low >= 0 else s["lo"],
                          float(points[high]) if high < len(points) else s["hi"]))
        counts = df.agg(*[e for i, (lo, hi) in enumerate(found) for e in (
            F.sum((v < lo).cast("long")).alias(f"b{i}"), F.sum((v <= hi).cast("long")).alias(f"u{i}"))]).first()
        for i, (s, (lo, hi)) in enumerate(zip(work, found)):
            below, upto = counts[f"b{i}"], counts[f"u{i}"]
            if not below <= math.floor(s["rank"]) or not upto > math.ceil(s["rank"]):
                raise RuntimeError("quantile bracket missed its rank")
            # a hot value at the edge of the bracket cannot be narrowed away, but it counts as one value
            s["stuck"] = upto - below > s["inside"] * 0.5
            s.update(lo=lo, hi=hi, below=below, inside=upto - below)
    tests = [F.coalesce(v.between(s["lo"], s["hi"]), F.lit(False)) for s in slots]
    entries = [F.when(t, F.struct(F.lit(i).alias("slot"), v.alias("v"))) for i, t in enumerate(tests)]
    counted = (df.where(reduce(lambda a, b: a | b, tests))
               .select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
               .groupBy(F.col("e.slot").alias("slot"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    below = F.get(F.array(*[F.lit(s["below"]).cast("long") for s in slots]), F.col("slot"))
    rank = F.get(F.array(*[F.lit(s["rank"]) for s in slots]), F.col("slot"))
    cum = counted.select("slot", "v", (below + _running(["slot"])).alias("cum"), rank.alias("rank"))
    got = {r["slot"]: r["value"] for r in _between_ranks(cum, ["slot"]).collect()}
    return [got[i] for i in range(len(slots))]


def group_quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], p: float) -> DataFrame:
    """Exact ``p``-quantile of each column per group: keys + one column per input column."""
    keys, cols = list(keys), list(cols)
    pieces = None
    for i, c in enumerate(cols):
        rows = df.select(*[F.col(f"`{k}`") for k in keys], clean_double(c).alias("v"))
        one = _one_per_group(rows, keys, float(p)).withColumn("i", F.lit(i))
        pieces = one if pieces is None else pieces.unionByName(one)
    return pieces.groupBy(*keys).agg(*[
        F.max(F.when(F.col("i") == i, F.col("value"))).alias(c) for i, c in enumerate(cols)])


def _one_per_group(every: DataFrame, keys: list[str], p: float) -> DataFrame:
    rows = every.where(F.col("v").isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= LIMIT:
        counted = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
        total = F.sum("c").over(Window.partitionBy(*keys))
        return _between_ranks(counted.select(*keys, "v", _running(keys).alias("cum"),
                                             (F.lit(p) * (total - 1)).alias("rank")), keys)
    inf = float("inf")
    brackets = cut_lineage(sizes.select(
        *keys, (F.lit(p) * (F.col("n") - 1)).alias("rank"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"),
        F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    largest = None
    for _ in range(ROUNDS):
        left = brackets.where(F.col("lo") < F.col("hi")).agg(F.max("inside")).first()[0] or 0
        if left <= LIMIT or (largest is not None and left > 0.5 * largest):
            break
        largest = left
        brackets = cut_lineage(_narrow(rows, brackets, keys))
    near = _with_brackets(rows, brackets, keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
    counted = near.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"), F.first("rank").alias("rank"),
                                           F.first("below").alias("below"))
    return _between_ranks(counted.select(*keys, "v", (F.col("below") + _running(keys)).alias("cum"), "rank"), keys)


def _with_brackets(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """One bracket row per group: Spark broadcasts it if it is small, else AQE splits a crowded group."""
    right = brackets.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in brackets.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(right, same).drop(*[f"__{k}" for k in keys])


def _narrow(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """One round: a salted sketch per group, a tighter bracket from its points, and a recount."""
    near = _with_brackets(rows, brackets, keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
    parts = near.groupBy(*keys, _salt().alias("salt")).agg(
        F.count(F.lit(1)).alias("m"), F.percentile_approx("v", _points(), ACCURACY).alias("a"),
        *[F.first(c).alias(c) for c in ("rank", "lo", "hi", "below", "inside")])
    points = parts.select(*keys, "rank", "lo", "hi", "below", "inside", (F.col("m") / POINTS).alias("c"),
                          F.explode("a").alias("v"))
    at, slack = F.col("rank") - F.col("below"), F.col("inside") * _margin() + 2
    tight = (points.withColumn("reach", _running(keys)).groupBy(*keys).agg(
        F.first("rank").alias("rank"),
        F.coalesce(F.max(F.when(F.col("reach") <= at - slack, F.col("v"))), F.first("lo")).alias("lo"),
        F.coalesce(F.min(F.when(F.col("reach") >= at + slack, F.col("v"))), F.first("hi")).alias("hi")))
    counted = _with_brackets(rows, tight, keys).groupBy(*keys).agg(
        F.first("rank").alias("rank"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        F.sum((F.col("v") < F.col("lo")).cast("long")).alias("below"),
        F.sum(F.col("v").between(F.col("lo"), F.col("hi")).cast("long")).alias("inside"))
    held = (F.col("below") <= F.floor("rank")) & (F.col("below") + F.col("inside") > F.ceil("rank"))
    return counted.withColumn("inside", F.when(held, F.col("inside")).otherwise(
        F.raise_error(F.lit("quantile bracket missed its rank")).cast("long")))
